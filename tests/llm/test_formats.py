import gzip
import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.llm import matroska as mk
from assayframe.llm import warc
from assayframe.llm.common import stored
from assayframe.llm.queries import QUERIES


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 8, 192 * 9, 192 * 300, 192 * 600 + 5])
def test_audio_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    payload = mk.payload_of(raw)
    assert len(payload) % 192 == 0 and payload.startswith(raw) and len(payload) >= 192
    data = mk.audio_file(payload)
    found = mk.parse(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in found.packets) == payload
    assert [p.timestamp for p in found.packets] == [24 * k for k in range(len(payload) // 192)]
    assert [c[2] for c in found.cues] == found.clusters and found.tracks[1]["bits"] == 8


def block(track, time, flags, body):
    return mk.number(track) + time.to_bytes(2, "big", signed=True) + bytes([flags]) + body


@pytest.mark.parametrize("how", [mk.XIPH_LACING, mk.EBML_LACING])
def test_uneven_lacing(how):
    frames = [bytes([k]) * n for k, n in enumerate([300, 1, 255, 0, 70_000, 3])]
    cluster = mk.uint(mk.TIMESTAMP, 1000) + mk.element(mk.SIMPLE_BLOCK, block(2, -5, how, mk.laced(frames, how)))
    data = mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, mk.element(0xEC, b"void") + mk.element(mk.CLUSTER, cluster))
    found = mk.parse(data)
    assert [data[p.offset : p.offset + p.size] for p in found.packets] == frames
    assert {(p.track, p.timestamp, p.keyframe) for p in found.packets} == {(2, 995, False)}


def test_unknown_sizes_groups_and_cut_files():
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block(1, 7, mk.FIXED_LACING, b"\x01" + b"aabb")) + mk.uint(mk.BLOCK_DURATION, 10))
    live = lambda code, body: code.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    one = live(mk.CLUSTER, mk.uint(mk.TIMESTAMP, 0) + group)
    two = live(mk.CLUSTER, mk.uint(mk.TIMESTAMP, 50) + mk.element(mk.SIMPLE_BLOCK, block(1, 0, 0x80, b"zz")))
    data = mk.element(mk.EBML, b"") + live(mk.SEGMENT, one + two)
    found = mk.parse(data)
    assert [(p.timestamp, data[p.offset : p.offset + p.size]) for p in found.packets] == [(7, b"aa"), (12, b"bb"), (50, b"zz")]
    assert len(mk.parse(data[:-12]).packets) == 2
    with pytest.raises(ValueError, match="not an EBML file"):
        mk.parse(b"RIFF....")


def every_lacing():
    """A file with all lacings, in simple blocks and in groups, the second group with a reference; and what it holds."""
    frames = [bytes([65 + k]) * n for k, n in enumerate([3, 300, 1, 2])]
    even = [b"aa", b"bb", b"cc"]
    ref = mk.element(mk.REFERENCE_BLOCK, b"\xff")
    one = mk.uint(mk.TIMESTAMP, 10) + mk.element(mk.SIMPLE_BLOCK, block(1, 1, 0x80, b"solo"))
    for how, own in ((mk.XIPH_LACING, frames), (mk.EBML_LACING, frames), (mk.FIXED_LACING, even)):
        one += mk.element(mk.SIMPLE_BLOCK, block(1, 2, how, mk.laced(own, how)))
        one += mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block(2, 3, how, mk.laced(own, how))) + (ref if how == mk.EBML_LACING else b""))
    track = mk.element(mk.TRACKS, mk.element(mk.TRACK_ENTRY, mk.uint(mk.TRACK_NUMBER, 2) + mk.uint(mk.DEFAULT_DURATION, 5_000_000)))
    data = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"matroska")) + mk.element(mk.SEGMENT, mk.element(0xEC, b"void") + track + mk.element(mk.CLUSTER, one))
    held = [b"solo"]
    for own in (frames, frames, even):
        held += own + own
    return data, held


def test_files_cut_at_every_byte():
    data, held = every_lacing()
    whole = mk.parse(data)
    assert [data[p.offset : p.offset + p.size] for p in whole.packets] == held
    assert [(p.timestamp, p.keyframe) for p in whole.packets if p.track == 2] == [(13 + 5 * k, True) for k in range(4)] + [(13 + 5 * k, False) for k in range(4)] + [(13 + 5 * k, True) for k in range(3)]
    assert [p.keyframe for p in whole.packets if p.track == 1] == [True] + [False] * 11
    sound = mk.audio_file(mk.payload_of(bytes(range(256)) * 14))
    live = mk.element(mk.EBML, b"") + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.CLUSTER.to_bytes(4, "big") + b"\xff" + mk.uint(mk.TIMESTAMP, 0) + mk.element(mk.SIMPLE_BLOCK, block(1, 0, 0x80, b"zz"))
    for file in (data, sound, live):
        full = [(p.track, p.timestamp, p.offset, p.size) for p in mk.parse(file).packets]
        assert full
        for cut in range(len(file)):
            got = mk.parse(file[:cut])
            assert [(p.track, p.timestamp, p.offset, p.size) for p in got.packets] == [p for p in full if p[2] + p[3] <= cut]
    for broken in (b"RIFF", data[:60] + b"\x00" * 40, b"\x00"):
        with pytest.raises(ValueError):
            mk.parse(broken)


def read_back(data):
    """The frames of a file by a reader of its own: nested elements by their sizes, lacing by the format's rules."""

    def number(at, keep=False):
        n = next(k for k in range(1, 9) if data[at] >> (8 - k))
        v = int.from_bytes(data[at : at + n], "big")
        return (v if keep else v - (1 << 7 * n)), at + n

    def walk(at, end):
        while at < end:
            code, at = number(at, True)
            size, at = number(at)
            if code in (0x18538067, 0x1F43B675):
                yield from walk(at, at + size)
            else:
                yield code, at, at + size
            at += size

    frames, times, base = [], [], 0
    for code, at, end in walk(0, len(data)):
        if code == 0xE7:
            base = int.from_bytes(data[at:end], "big")
        if code != 0xA3:
            continue
        track, at = number(at)
        assert track == 1
        start, how, at = base + int.from_bytes(data[at : at + 2], "big"), data[at + 2] >> 1 & 3, at + 3
        sizes = []
        if how:
            count, at = data[at] + 1, at + 1
            if how == 1:
                while len(sizes) < count - 1:
                    sizes.append(0)
                    while data[at] == 255:
                        sizes[-1] += 255
                        at += 1
                    sizes[-1] += data[at]
                    at += 1
            elif how == 3:
                n, at = number(at)
                sizes.append(n)
                while len(sizes) < count - 1:
                    was = at
                    d, at = number(at)
                    sizes.append(sizes[-1] + d - (2 ** (7 * (at - was) - 1) - 1))
            else:
                sizes = [(end - at) // count] * (count - 1)
        sizes.append(end - at - sum(sizes))
        for n in sizes:
            frames.append((at, n))
            times.append(start)
            start, at = start + n // 8, at + n  # 8000 samples a second
    return frames, times


def test_media_of_odd_tables(spark, odd_docs, no_docs):
    media = mk.store_texts(odd_docs).persist()
    rows = mk.features(media).collect()
    want = Counter(hashlib.sha256(mk.payload_of(r["text"])).hexdigest() for r in odd_docs.collect())
    assert Counter(r["payload_sha256"] for r in rows) == want
    for r in rows:
        assert r["payload_bytes"] % 192 == 0 and r["n_bytes"] <= r["payload_bytes"]
    given = media.union(spark.createDataFrame([(50, 0, None)], media.schema)).withColumn("packet", F.lit("clash"))
    packets = Counter((r["doc_id"], r["packet"], r["track"], r["timestamp_ns"], r["offset"], r["size"], r["keyframe"]) for r in mk.packet_table(given).collect())
    expected = Counter()
    for r in media.collect():
        frames, times = read_back(bytes(r["media"]))
        expected.update((r["doc_id"], k, 1, t * 1_000_000, at, n, True) for k, ((at, n), t) in enumerate(zip(frames, times)))
    assert packets == expected
    assert mk.features(mk.store_texts(no_docs)).count() == 0 and mk.packet_table(mk.store_texts(no_docs)).count() == 0


def test_media_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    files = {r["doc_id"]: bytes(r["media"]) for r in mk.store_texts(docs).collect()}
    rows = QUERIES["op8_media_columns"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw, data = texts[r["doc_id"]], files[r["doc_id"]]
        size = max(192, -(-len(raw) // 192) * 192)
        payload = raw.ljust(size, b" ")
        frames, _ = read_back(data)
        assert b"".join(data[at : at + n] for at, n in frames) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"], r["tail_crc32"]) == (len(raw), size, len(data), zlib.crc32(payload[-16:]))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(data).hexdigest())
        n = size // 192
        clusters = -(-n // 256)
        blocks = -(-n // 8)
        assert r["feature"] == f"A_PCM/INT/LIT;8000Hz;packets={n};blocks={blocks};clusters={clusters};cues={clusters};ms={n * 24};level={sum(payload) * 1000 // size}"


def test_archives_round_trip(spark, tmp_path):
    pages = [(k, f"http://a/{k}", f"<p>{k % 7}</p>" * 20) for k in range(40)]
    pages += [(100, None, None), (101, "u\r\nx", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "é" * 60), (105, "u", "x" * 300_000), (None, "u", "é" * 60), (7, "http://a/7", "<p>0</p>" * 20)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    streams, members = tmp_path / "streams", tmp_path / "members"
    archives = stored(warc.write_archives(warc.decide(frame), str(streams), archive_bytes=5000), "archives")
    index = stored(warc.normalise(archives, f"file:{streams}", f"file://{members}"), "index")
    got = Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(index, str(members)).collect())
    first = {}
    for k, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(h or "", k)
    want = Counter()
    for k, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 100 and k != first[h or ""]
        want[(k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert got == want
    # the old archives are one stream each; the new ones have a member for each record, at the index's offsets
    old = {p.name: p.read_bytes() for p in streams.iterdir()}
    assert len(old) == archives.count() > 3 and archives.agg(F.sum("records")).first()[0] == len(pages) == index.count()
    for data in old.values():
        stream = zlib.decompressobj(31)
        stream.decompress(data)
        assert stream.eof and not stream.unused_data
    texts = Counter()
    for p in members.iterdir():
        data, rows = p.read_bytes(), index.where(F.col("archive") == p.name).orderBy("offset").collect()
        parts = [gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in rows]
        assert sum(r["length"] for r in rows) == len(data) and all(m.startswith(b"WARC/1.1\r\n") for m in parts)
        texts[b"".join(parts)] += 1
    assert texts == Counter(map(gzip.decompress, old.values()))
    # one record by its range alone: the other bytes of its archive may be anything
    one = index.where("record_id = '<urn:page:105>'")
    at = one.first()
    data = (members / at["archive"]).read_bytes()
    (members / at["archive"]).write_bytes(b"?" * at["offset"] + data[at["offset"] : at["offset"] + at["length"]] + b"?" * 50)
    whole = warc.read_records(one, str(members), with_payload=True).first()
    assert bytes(whole["payload"]) == b"x" * 300_000 and whole["id"] == 105


def test_query_with_repeated_pages(spark, tmp_path):
    """The registered query where a third of all pages have one payload, and others theirs twice."""
    rows = [(k, f"http://h/{k}", "<p>" + "a" * 200 if k % 3 == 0 else f"<p>{k // 6}</p>" * 30 if k % 3 == 1 else "b" * 99) for k in range(300)] + [(300, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: tuple(r)[1:] for r in QUERIES["op10_warc"](spark, str(tmp_path)).collect()}
    first, want = {}, {}
    for k, _, h in rows:
        raw = (h or "").encode()
        to = first.setdefault(raw, k)
        again = to != k and len(raw) >= 100
        want[k] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", to if again else None)
    assert got == want and sum(w[2] == "revisit" for w in want.values()) == 149


def rewritten(data):
    """Members and index of an archive given as bytes."""
    out = io.BytesIO()
    index = list(warc.normalise_archive(io.BytesIO(data).read, out.write))
    return [gzip.decompress(out.getvalue()[a : a + n]) for a, n, _, _ in index], [(kind, key) for _, _, kind, key in index]


def test_archives_cut_padded_or_broken(spark, tmp_path, monkeypatch):
    one, two = (warc.record_bytes(str(k), "u", b"abc" * k, "d", "response", None) for k in (1, 2))
    told = [("response", "<urn:page:1>"), ("response", "<urn:page:2>")]
    members = gzip.compress(one) + gzip.compress(two)
    assert rewritten(members) == ([one, two], told)
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(warc, "READ", size)
        assert rewritten(members[:-20]) == ([one], told[:1])
        assert rewritten(gzip.compress(one + two[:-9])) == ([one], told[:1])
        # zero padding, between members and at the end, and what isn't a member behind the last
        assert rewritten(gzip.compress(one) + bytes(600) + gzip.compress(two) + bytes(100_000)) == ([one, two], told)
        assert rewritten(members + b"trailer") == ([one, two], told)
        assert rewritten(b"") == rewritten(bytes(50)) == rewritten(b"plain") == ([], [])
        # a head without length, one with a wrong one, and bytes that are no record: kept, and passed over
        bad = one.replace(b"Content-Length: ", b"Content-Size: ", 1)
        odd = one.replace(b"Content-Length: ", b"Content-Length: x", 1)
        assert rewritten(gzip.compress(bad + two + odd + one)) == ([bad, two, odd, one], [(None, None), told[1], (None, None), told[0]])
        assert rewritten(gzip.compress(b"\r\nnoise" + one + b"end")) == ([b"\r\nnoise", one, b"end"], [(None, None), told[0], (None, None)])
    broken = bytearray(gzip.compress(one + two * 50))
    broken[len(broken) // 2] ^= 0xFF
    assert rewritten(bytes(broken))[0][:1] in ([one], [])
    none = spark.createDataFrame([], "page_id long, url string, html string")
    archives = stored(warc.write_archives(warc.decide(none), str(tmp_path / "a")), "none")
    assert archives.count() == 0 and warc.read_records(stored(warc.normalise(archives, str(tmp_path / "a"), str(tmp_path / "b")), "none"), str(tmp_path / "b")).count() == 0
    # a stream larger than any cell of a table would be is read in pieces: what is held at once stays small
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc.gz").write_bytes(gzip.compress(bad + two))
    index = stored(warc.normalise(spark.createDataFrame([("x.warc.gz", 0)], "archive string, n int"), str(tmp_path / "bad"), str(tmp_path / "good")), "index")
    assert index.count() == 2 and [r["id"] for r in warc.read_records(index, str(tmp_path / "good")).collect()] == [2]


def test_large_streams_are_never_held():
    import tracemalloc

    def stream():
        press, total = zlib.compressobj(1, zlib.DEFLATED, 31), 0
        for k in range(3000):
            yield press.compress(warc.record_bytes(str(k), "u", b"%d" % k * 10_000, "d", "response", None))
        yield press.flush()

    pieces, held = stream(), bytearray()

    def read(n):
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                break
            held.extend(piece)
        out = bytes(held[:n])
        del held[:n]
        return out

    tracemalloc.start()
    seen = sum(1 for _ in warc.normalise_archive(read, len))
    assert seen == 3000 and tracemalloc.get_traced_memory()[1] < 40_000_000  # of 110 MB
    tracemalloc.stop()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from assayframe.llm import curriculum

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf_dir).persist())
    good, single, apart, mixed, coded = steps[1:]
    assert 0.5 * docs.count() < good.count() < docs.count()
    texts = [r["text"] or "" for r in good.collect()]
    assert sorted(r["text"] for r in single.collect()) == sorted(set(texts))
    from assayframe.llm import minhash

    groups = minhash.near_duplicates(single, 80, 100).where("kept")
    assert apart.count() == groups.count()
    copies = curriculum.mix(apart, corpus_pipeline.MIX_WEIGHTS).agg(F.sum("copies")).first()[0]
    assert mixed.count() == coded.count() == copies
    assert coded.join(docs, "doc_id").where("decoded <> text").isEmpty()
    assert corpus_pipeline.run(spark, sf_dir).count() == copies
    for step in steps[1:-1]:
        assert step.columns == docs.columns


def test_stages_of_an_empty_or_odd_table(spark, sf_dir, odd_docs):
    import corpus_pipeline

    odd = odd_docs.withColumn("n_chars", F.lit(1).cast("long")).withColumn("extra", F.lit("x"))
    for docs in (odd, odd.limit(0)):
        rows = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality" and rows:  # judged well enough, all of them: the other stages are to see the odd rows
                docs = docs.select(*corpus_pipeline.COLUMNS)
                continue
            docs = stage(spark, docs, sf_dir)
            got = docs.count()
            assert (got > 0) == (rows > 0) and (name == "sentencepiece" or docs.columns == corpus_pipeline.COLUMNS)
            if name in ("exact_dedup", "near_dedup"):
                texts = [r["text"] or "" for r in docs.collect()]
                assert len(texts) == len(set(texts))


def test_order_of_the_mix_survives_storage(spark, tmp_path):
    import corpus_pipeline
    from assayframe.llm import curriculum

    rows = [(k, f"w{k} " * (1 + k * k % 50), "en", "ab"[k % 2], 1) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    adaptive, parts = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        corpus_pipeline.mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(list((tmp_path / "mixed").glob("part-*"))) >= 10
    got = [r["doc_id"] for r in corpus_pipeline.sentencepiece(spark, spark.read.parquet(str(tmp_path / "mixed")), "").orderBy("place").collect()]
    mixed = curriculum.mix(docs, corpus_pipeline.MIX_WEIGHTS, schedules=corpus_pipeline.MIX_SCHEDULES).collect()
    want = sorted((p, r["doc_id"]) for r in mixed for p in r["positions"])
    assert got == [d for _, d in want]


def test_near_dedup_removes_rows_not_ids(spark):
    import corpus_pipeline

    prose = lambda seed, n: " ".join(f"w{seed * 1000 + k}" for k in range(n))
    base = prose(1, 60)
    rows = [(1, base), (None, base + " tail"), (None, prose(2, 60)), (10, base + " end"), (10, prose(4, 60)), (None, None), (11, None), (12, prose(5, 60)), (None, prose(5, 60))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.near_dedup(spark, frame, "")
    want = [rows[k] for k in (0, 2, 4, 5, 6, 7)]
    assert left.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(want)


def test_near_dedup_and_mixing_against_brute_force(spark):
    import random

    import corpus_pipeline
    from test_native import fill, nearest
    from test_texts import brute_components

    draw = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):  # near copies from about 0.6 to 1, some under null and repeated ids, and texts of their own
        own = list(base) if k % 2 else [f"o{k}-{j}" for j in range(draw.randint(0, 90))]
        for _ in range(k % 7):
            if own:
                own[draw.randrange(len(own))] = f"v{draw.randint(0, 10**6)}"
        rows.append((None if k % 5 == 0 else 40 + k % 23, " ".join(own), "ab"[k % 2]))
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    _, group = brute_components([(i, t) for i, t, _ in rows], 80, 100)
    order = lambda k: 2**63 - 1 if rows[k][0] is None else rows[k][0]
    members = {g: [k for k in range(len(rows)) if group[k] == g] for g in group}
    left = corpus_pipeline.near_dedup(spark, frame, "").persist()
    stay = Counter((r["doc_id"], r["text"], r["source"]) for r in left.collect())
    # one row of each group, of those with its smallest id; a text without words is a group of its own
    for own in members.values():
        least = min(map(order, own))
        assert sum(stay[rows[k]] for k in own) == 1
        assert any(stay[rows[k]] for k in own if order(k) == least)
    assert sum(stay.values()) == len(members) < len(rows) - 5

    mixed = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.mixing(spark, left, "").collect())
    sizes = Counter()
    for _, t, s in stay:
        sizes[s] += len(t.split())
    want = fill(sizes, {s: corpus_pipeline.MIX_WEIGHTS[k] for k, s in enumerate(sorted(sizes))}, 1.5, 2.0)
    assert set(mixed) <= set(stay) and max(mixed.values()) <= 2
    for s, target in want.items():
        mine = [len(t.split()) for _, t, own in stay if own == s]
        taken = sum(n * len(t.split()) for (_, t, own), n in mixed.items() if own == s)
        assert abs(target - taken) <= nearest(mine, 2, target) + 1


def test_quality_stage_against_plain_python(spark, sf_dir):
    """The stage's rows, from the labels and the texts, with the scores computed one by one and the cut by sorting."""
    import zlib

    import corpus_pipeline
    from assayframe.llm import pairwise_quality as pq

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in texts}
    ids = sorted(labels)
    x = np.array([pq.features(texts[i]) for i in ids])
    good = np.array([labels[i] == 1 for i in ids])
    # the Bradley-Terry loss by plain gradient descent on the same pairs, and the cut at the share of bad labels
    ranking = pq.learn(x, good)
    z = np.clip((x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0)), -8, 8)
    draw = np.random.default_rng(7)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = min(pq.PAIRS, 50 * len(x))
    d = z[draw.choice(better, pairs)] - z[draw.choice(worse, pairs)]
    loss = lambda w: float(np.log1p(np.exp(-np.clip(d @ w, -500, 500))).mean() + pq.RIDGE / 2 * w @ w)
    slope = pq.RIDGE * ranking.weights - d.T @ (1 / (1 + np.exp(np.clip(d @ ranking.weights, -500, 500)))) / pairs
    assert np.abs(slope).max() < 1e-6
    assert all(loss(ranking.weights) <= loss(ranking.weights + 1e-3 * e) for e in np.eye(len(ranking.weights)))
    scores = sorted(float(row @ ranking.weights) for row in z)
    bad = round((~good).mean() * len(scores))
    assert scores[bad - 1] <= ranking.cut <= scores[bad]
    score = lambda t: float(np.clip((np.array(pq.features(t)) - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0)), -8, 8) @ ranking.weights)
    want = {i for i, t in texts.items() if score(t) >= ranking.cut}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()} == want
    told = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in QUERIES["op4_quality_classifier"](spark, sf_dir).collect()}
    assert told.keys() == texts.keys()
    for i, (held, p, said) in told.items():
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1) and said == (i in want)
        assert p == pytest.approx(1 / (1 + np.exp(-(score(texts[i]) - ranking.cut))), abs=1e-9)
