import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from comparing import same_rows
from pyspark.sql import functions as F

from assayframe.llm import lattice_lm, line_dedup, merge_table, minhash, pairwise_quality
from assayframe.llm.queries import ORACLES, QUERIES, piece_model


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


# ---- line dedup ----------------------------------------------------------


def brute_lines(docs):
    seen, out = {}, []
    for key, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for k in range(len(at) - 2):
            w = tuple(lines[i].strip(" \t\r\x0b\x0c") for i in at[k : k + 3])
            if seen.setdefault(w, (key, k)) != (key, k):
                gone |= set(range(at[k], at[k + 2] + 1))
        # adjoining spans merge, with the blank lines between them
        places = sorted(at.index(i) for i in gone if i in at)
        for a, b in zip(places, places[1:]):
            if b == a + 1:
                gone |= set(range(at[a], at[b] + 1))
        out.append((key, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


def test_lines_against_brute_force(spark):
    draw = random.Random(4)
    docs = [(k, "\n".join(draw.choice(["a", "b", "c", " a ", "", "d"]) for _ in range(draw.randint(0, 14)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "x\n" * 3000), (103, "p\nq\nr"), (104, "p\nq\nr"), (105, "p\n\n q\nr\nz")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, hash string").repartition(3)
    got = line_dedup.dedupe_lines(frame).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["removed_lines"]) for r in got) == sorted(brute_lines(docs))


def test_lines_of_odd_tables(odd_docs, no_docs):
    assert line_dedup.dedupe_lines(odd_docs).count() == 14
    assert line_dedup.dedupe_lines(no_docs).count() == 0


def test_lines_repeated_among_documents_without_an_id_of_their_own(spark):
    said = "p\nq\nr"
    docs = [(None, said + "\nx"), (None, said + "\ny"), (5, "a\nb\nc\nd"), (5, "a\nb\nc\ne"), (6, "a\nb\nc")]
    got = line_dedup.dedupe_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    first = {i: min((t for k, t in docs if k == i), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for i in (None, 5)}
    want = [(i, t if first.get(i) == t else t[6:]) for i, t in docs]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)


# ---- language model ------------------------------------------------------


def segmentations(s, known, unit):
    """All ways to cut ``s`` into pieces (a character without a piece is its bytes), with the pieces of each."""
    if not s:
        yield ()
    for e in range(1, len(s) + 1):
        if s[:e] in known:
            first = (known[s[:e]],)
        elif e == 1:
            first = tuple(int(unit[x]) for x in s[:1].encode())
        else:
            continue
        for rest in segmentations(s[e:], known, unit):
            yield first + rest


def brute_lattice(s, known, unit, logq):
    """Log of the sum over all segmentations, character by character."""
    sums = [0.0] + [-math.inf] * len(s)
    for e in range(1, len(s) + 1):
        ways = [sums[b] + logq[known[s[b:e]]] for b in range(max(0, e - 40), e) if s[b:e] in known]
        if s[e - 1] not in known:
            ways.append(sums[e - 1] + sum(logq[unit[x]] for x in s[e - 1].encode()))
        sums[e] = np.logaddexp.reduce(ways)
    return sums[-1]


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.pieces_of(piece_model())
    known = {p: pieces.automaton.get(p) for p in pieces.automaton.keys()}
    words = ["the", "", "other", "x①", "日本", "a▁b", "z" * 100]
    got, used = pieces.marginals(words, pieces.start, np.ones(len(words)))
    assert got == pytest.approx([brute_lattice("▁" + w, known, pieces.bytes, pieces.start) for w in words], abs=1e-9)
    letters = sum((pieces.lengths * used)[pieces.lengths > 0])
    assert letters == pytest.approx(sum(len(w) + 1 for w in words) - 1, abs=1e-6)  # all characters but the one without a piece
    # expected uses, with every segmentation written out
    few, times = ["the", "other", "x①", "日本"], np.array([1.0, 2.0, 1.0, 3.0])
    want = np.zeros(pieces.size)
    for w, n in zip(few, times):
        ways = list(segmentations("▁" + w, known, pieces.bytes))
        odds = np.array([math.exp(sum(pieces.start[p] for p in way)) for way in ways])
        for way, share in zip(ways, odds / odds.sum()):
            for p in way:
                want[p] += n * share
    assert pieces.marginals(few, pieces.start, times)[1] == pytest.approx(want, abs=1e-9)


def test_long_words_in_bounded_memory(monkeypatch):
    import tracemalloc

    pieces, draw = lattice_lm.pieces_of(piece_model()), random.Random(3)
    word = "".join(draw.choice("abcdefg①日 é".replace(" ", "")) for _ in range(500))
    total, used = pieces.long_marginal(word, pieces.start, True)
    monkeypatch.setattr(lattice_lm, "LONG", 10**9)
    (want,), uses = pieces.marginals([word], pieces.start, np.ones(1))
    assert total == pytest.approx(want, abs=1e-8) and used == pytest.approx(uses, abs=1e-8)
    monkeypatch.undo()
    for size in (7, 64):
        monkeypatch.setattr(lattice_lm, "PART", size)
        again, same = pieces.long_marginal(word, pieces.start, True)
        assert again == pytest.approx(total, abs=1e-9) and same == pytest.approx(used, abs=1e-9)
    monkeypatch.undo()
    tracemalloc.start()
    got, _ = pieces.marginals(["ab" * 100_000], pieces.start)
    assert np.isfinite(got[0]) and tracemalloc.get_traced_memory()[1] < 16_000_000
    tracemalloc.stop()


def test_score_against_brute_force(spark):
    """Whole texts, word by word: each the text's own so far, or by its arcs, as the docstring says."""
    draw = random.Random(8)
    said = ["alpha", "beta", "Gamma", "日本", "x①", "the", "unseen"]
    rows = [(k, " ".join(draw.choice(said[: 3 + k % 5]) for _ in range(k % 9))) for k in range(60)] + [(100, None), (101, "new words neWords " + "q" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = F.col("doc_id") % 4 != 1
    model = lattice_lm.fit(docs, train, piece_model())
    pieces = lattice_lm.pieces_of(piece_model())
    known = {p: pieces.automaton.get(p) for p in pieces.automaton.keys()}
    texts = {k: (t or "").encode().lower().split() for k, t in rows}
    c = Counter(w for k, t in texts.items() if k % 4 != 1 for w in t)
    seen, ends = sum(c.values()), sum(k % 4 != 1 for k in texts)
    assert (model.tokens, model.types, model.ends) == (seen + ends, len(c) + 1, ends)
    # pieces by the passes of expectation-maximisation over distinct words, with every segmentation summed
    logq = pieces.start
    for _ in range(lattice_lm.PASSES):
        used = sum(pieces.marginals([w.decode()], logq, np.ones(1))[1] for w in c)
        total, prior = used.sum(), np.exp(pieces.start)
        logq = np.log((used + prior * len(prior) + 1e-12 * (prior > 0)) / (total + len(prior)) + 1e-300)
    stop = min(max(len(c) / total, 1e-3), 0.999)
    path = {w: brute_lattice("▁" + w.decode(), known, pieces.bytes, logq + math.log1p(-stop)) - math.log1p(-stop) + math.log(stop) for t in texts.values() for w in t}
    likely = lambda x: sum(n * math.log((1 - x) * (n - 1) / (seen - 1) + x * math.exp(path[w])) for w, n in c.items())
    assert model.novel == pytest.approx(max(lattice_lm.SHARES, key=likely))
    p = {w: (1 - model.novel) * c[w] / seen + model.novel * math.exp(path[w]) for w in path}
    end = (ends + 0.5) / (seen + ends + 1)
    got = {r["doc_id"]: r["score"] for r in lattice_lm.score_texts(docs, model).collect()}
    for k, words in texts.items():
        so_far, want = Counter(), math.log10(end)
        for n, w in enumerate(words):
            if p[w] > 0:
                want += math.log10(1 - end) + math.log10((so_far[w] + lattice_lm.CACHE * p[w]) / (n + lattice_lm.CACHE))
            else:
                want += math.log10(1 - end) + (path[w] + math.log(model.novel) + math.log(lattice_lm.CACHE / (n + lattice_lm.CACHE))) / math.log(10)
            so_far[w] += 1
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_model_is_worth_its_cost(spark):
    """On held-out texts whose words are all known the model is to beat the add-one-half base."""
    got = QUERIES["op2_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out AND n_known = n_tokens")
    told = got.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.count(F.lit(1)).alias("n")).first()
    assert told["n"] > 20 and told["score"] >= told["base"]


def test_scores_against_counts(spark, odd_docs):
    docs = odd_docs.union(spark.createDataFrame([(100 + k, "alpha beta " * (k % 5) + f"rare{k}") for k in range(50)], "doc_id long, text string").select(*[F.col(c) if c in ("doc_id", "text") else F.lit(None).alias(c) for c in odd_docs.columns]))
    train = pairwise_quality.id_remainder(F.col("doc_id"), 5) != 1
    model = lattice_lm.fit(docs, train, piece_model())
    got = lattice_lm.score_texts(docs, model).collect()
    model.hot_from = 10**9  # no word is hot: every score comes by the join
    other = lattice_lm.score_texts(docs, model).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6))
    for a, b in zip(sorted(got, key=key), sorted(other, key=key)):
        assert a[0] == b[0] and tuple(a)[1:] == pytest.approx(tuple(b)[1:], rel=1e-9)
    rows = docs.select("doc_id", "text").collect()
    c = Counter()
    for r in rows:
        if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 != 1:
            c.update((r["text"] or "").encode().lower().split())
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    want = sorted(
        (len(t) + 1, sum(c[w] > 0 for w in [*t, "end"]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, "end"]), 5))
        for t in ((r["text"] or "").encode().lower().split() for r in rows)
    )
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_model_of_nothing(spark, no_docs):
    model = lattice_lm.fit(no_docs, F.lit(True), piece_model())
    assert lattice_lm.score_texts(no_docs, model).count() == 0
    one = spark.createDataFrame([(1, "new words"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lattice_lm.score_texts(one, model).collect()}
    assert got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["score"] < got[2]["score"] < 0


# ---- near duplicates -----------------------------------------------------


def brute_components(rows, num, den):
    """A row's set, and for each row a row that names its group."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    return sets, [find(k) for k in range(len(rows))]


def brute_groups(rows, num, den):
    sets, group = brute_components(rows, num, den)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[group[k]] = min(least.get(group[k], 2**63 - 1), 2**63 - 1 if i is None else i)
    out = []
    for k, (i, _) in enumerate(rows):
        m = least[group[k]]
        out.append((i, len(sets[k]), None if m == 2**63 - 1 else m, (2**63 - 1 if i is None else i) == m))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [512, 8])
def test_groups_against_brute_force(spark, odd_docs, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(9)
    base = [f"w{draw.randint(0, 400)}" for _ in range(200)]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for k in range(40):  # a large group of near copies, some linked through others only
        own = list(base)
        for _ in range(draw.randint(0, 5)):
            own[draw.randrange(200)] = f"v{draw.randint(0, 10**6)}"
        rows.append((1000 + k, " ".join(own)))
    for k in range(25):  # texts that share a passage and no more
        rows.append((2000 + k, " ".join(base[:80] + [f"u{draw.randint(0, 10**6)}" for _ in range(60)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(frame).collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows, 85, 100)


def test_large_buckets_meet_by_size(spark, monkeypatch):
    """A passage that texts of many sizes share: every link is found, and blocks of unlike size never meet."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    draw = random.Random(4)
    shared, rows = [f"w{k}" for k in range(60)], []
    for extra in range(0, 72, 8):  # the longer the more, so that a bucket holds about as many of each size
        for _ in range(int(4 * ((56 + extra) / 56) ** 5)):
            rows.append((len(rows), " ".join(shared + [f"u{draw.randint(0, 10**9)}" for _ in range(extra)])))
    for k in range(0, len(rows), 20):  # links of each size, some at the edge of what sizes allow
        words = rows[k][1].split()
        rows.append((1000 + k, " ".join(words[: max(60, int(len(words) * draw.choice([0.86, 0.9, 0.99])))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, whole = [], minhash.blocks

    def counted(*given):
        got = whole(*given)
        dealt.append(got.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("class").alias("classes")).collect())
        return got

    monkeypatch.setattr(minhash, "blocks", counted)
    got = sorted(map(tuple, minhash.near_duplicates(frame).collect()), key=repr)
    assert got == brute_groups(rows, 85, 100)
    assert sum(not r[3] for r in got) >= 8
    largest = max(dealt[1], key=lambda r: r["classes"])
    blocks = -(-largest["classes"] // 4)
    assert largest["classes"] > 20 and largest["rows"] < largest["classes"] * (blocks - 1) * 0.8


def test_rows_without_ids_send_a_set_once(spark):
    rows = [(None, " ".join(f"w{k}" for k in range(30)))] * 500 + [(5, " ".join(f"w{k}" for k in range(31)))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.where("component_id = 5").count() == 501 and got.where("kept").count() == 1


def test_no_groups_of_nothing(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_estimates_are_unbiased():
    draw = np.random.default_rng(2)
    got = []
    for _ in range(60):
        both, a, b = (draw.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
        x, y = (minhash.pack(minhash.minima(np.concatenate([both, z])))[None, :] for z in (a, b))
        got.append(minhash.estimates(x, y)[0])
    assert np.mean(got) == pytest.approx(0.75, abs=0.02)


# ---- quality -------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    told = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count(F.lit(1))).first()
    assert told[0] >= 0.95 and told[1] > 50


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (10, 1), (10, 0), (None, 1), (4, None), (5, 1)], "doc_id long, quality int")
    x, good = pairwise_quality.training_sample(odd_docs, labels, "quality")
    assert len(x) == 4 and good.tolist() == [True, True, False, True]
    ranking = pairwise_quality.learn(x, good)
    rows = pairwise_quality.score_texts(odd_docs, ranking).collect()
    assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows)
    kept = pairwise_quality.keep_good(odd_docs, ranking)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["score"] >= 0.5 for r in rows)
    assert pairwise_quality.score_texts(no_docs, ranking).count() == 0
    for labelled, score in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        only = pairwise_quality.learn(*pairwise_quality.training_sample(odd_docs, labelled, "quality"))
        assert only.probability(x).tolist() == [score] * len(x)


# ---- merge table ---------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_model())


def test_ids_equal_the_library(library):
    table, draw = merge_table.MergeTable(piece_model()), random.Random(1)
    marks = " \t\n▁aeinrstThé日本語🎉①ﬁ0123.,!<>|Ωж\u0000"
    texts = ["", " ", "<s> <0x41> <unk>", "▁▁▁", "a" * 5000, "\n" * 50]
    texts += ["".join(draw.choice(marks) for _ in range(draw.randint(0, 24))) for _ in range(3000)]
    texts += ["".join(draw.choice(table.pieces[3:]).replace("▁", " ") for _ in range(draw.randint(1, 6))) for _ in range(3000)]
    texts += [" " * draw.randint(0, 60) + draw.choice(["", "a", "①", "\n", "the"]) + " " * draw.randint(0, 40) for _ in range(300)]
    for text, ids in zip(texts, library.encode(texts, num_threads=1)):
        assert list(table.encode(text)) == ids, text
        assert table.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.choice([0, 1, 2, 28705, 259])]) for _ in range(draw.randint(0, 8))]
        assert table.decode(ids) == library.decode(ids)


def test_every_document_round_trips(spark, sf_dir, odd_docs, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    want = defaultdict(list)
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]].append((ids, library.decode(ids)))
    for r in merge_table.encode_texts(docs, piece_model()).collect():
        assert (r["ids"], r["decoded"]) in want[r["doc_id"]]


def test_query_digests(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op9_sentencepiece"](spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
