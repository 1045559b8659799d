"""Tables that the operators share.

``items``: one row an item.  ``responses``: one row a (model, item) cell, never
pivoted.  ``suite_id`` (and ``cohort`` in studies) leads every key, so that many
suites are analysed in one job; ``item_idx`` and ``model_idx`` carry the order
that ties and reports depend on, for rows have none.
"""

ITEMS = "suite_id string, item_idx int, item_id string, prompt string, tags array<string>, meta map<string,variant>"
RESPONSES = "suite_id string, model_idx int, model string, item_idx int, item_id string, passed int"
SUITE = ["suite_id"]
