"""Line dedup, WARC, sharding, packing and top-k against SQL or brute force, and on odd tables."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import linededup, packing, queries, sharding, topk, vocab, warc
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, name):
    same(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name])


def test_line_dedup_cases(spark, odd, nothing):
    out = linededup.dedup_lines(odd).select("doc_id", "text", "removed").collect()
    got = Counter((r["doc_id"], r["text"], tuple(r["removed"])) for r in out)
    lines = "first line here\nsecond line here\nthird line here"
    assert got[1, lines, ()] == 1 and got[2, "", (0, 1, 2)] == 2 and got[3, None, ()] == 1 and got[4, "", ()] == 1
    clean = linededup.clean_documents(odd.withColumn("removed", F.lit("mine")))
    assert len(out) == odd.count() and clean.columns == [*odd.columns, "removed"] and {r["removed"] for r in clean.collect()} == {"mine"}
    assert {(r["text"], r["n_chars"], r["score"]) for r in clean.where("doc_id = 1").collect()} == {(lines, 10, "x")}
    assert linededup.dedup_lines(nothing).count() == 0


def test_line_dedup_merges_overlaps_and_keeps_blanks(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\n\nb\nc\nd\ny"), (3, "c\nd\nq")], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["s"]) for r in linededup.dedup_lines(docs).select("doc_id", "text", linededup.spans(F.col("removed")).alias("s")).collect()}
    assert out[1] == ("a\nb\nc\nd", []) and out[3] == ("c\nd\nq", [])
    assert out[2] == ("x\n\ny", [(1, 1), (3, 5)])


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u", "same é"), (1, "v", "same é"), (2, None, None), (4, "w", ""), (None, "x", "same é"), (5, "y", "a\r\n\r\nb"), (5, "y", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path).collect()
    assert Counter((r["page_id"], bytes(r["payload"])) for r in got) == Counter((i, (h or "").encode()) for i, _, h in rows)
    kind = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kind == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("revisit", 2), None: ("revisit", 1), 5: ("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in got:
        f = warc.parse_header(bytes(r["header"]))
        assert f["WARC-Type"] == r["record_type"] and f["WARC-Payload-Digest"] == "sha1:" + r["digest"]
    warc.export_warc(spark, path, f"{tmp_path}/files")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    n = 0
    while text:
        head, _, rest = text.partition(b"\r\n\r\n")
        size = int(warc.parse_header(head + b"\r\n\r\n")["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        text, n = rest[size + 4 :], n + 1
    assert n == len(rows)


def test_warc_urls_cannot_end_their_line(spark, tmp_path):
    urls = ["http://x\r\nX-Refers-To-Page: 99", "http://y\n\x00%20\x7f", "no colon\r\n", "", None, "http://é/: :"]
    rows = [(1, urls[0], "p"), (2, urls[1], "p"), (2, urls[1], "p"), (3, urls[2], "q"), (None, urls[0], "p"), (None, urls[0], "p"), (4, urls[3], None), (5, urls[4], "r"), (6, urls[5], "r")]
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_archive(spark, path).collect()
    assert Counter((r["page_id"], r["target"], bytes(r["payload"])) for r in got) == Counter((i, u or "", (h or "").encode()) for i, u, h in rows)
    kind = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kind == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), None: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("revisit", 5)}
    heads = [warc.parse_header(bytes(r["header"])) for r in got]
    ids = {h["WARC-Record-ID"]: r["page_id"] for h, r in zip(heads, got, strict=True)}
    assert len(ids) == len(rows)
    assert all(ids[h["WARC-Refers-To"]] == r["refers_to"] for h, r in zip(heads, got, strict=True) if r["refers_to"] is not None)
    with pytest.raises(ValueError, match="no name"):
        warc.parse_header(b"WARC/1.1\r\nnothing\r\n\r\n")


def test_warc_detects_changed_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"tampered")).collect()
    spark.createDataFrame(bad, "sha256 string, payload_bytes long, payload_digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()
    empty = f"file://{tmp_path}/empty"
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def brute_ring(cells: list[int], shards: int) -> list[int]:
    """Keys in ring order, each clockwise to the next shard with room."""
    points = sharding.ring_points(shards)
    room = [len(cells) // shards + (s < len(cells) % shards) for s in range(shards)]
    out = []
    for c in cells:
        at = next((i for i, p in enumerate(points) if p[0] >= c), 0)
        while not room[points[at % len(points)][1]]:
            at += 1
        room[points[at % len(points)][1]] -= 1
        out.append(points[at % len(points)][1])
    return out


def test_ring_plan_equals_brute_force():
    rng = np.random.default_rng(5)
    cells = sorted(rng.integers(0, sharding.CELLS, 700).tolist() + [77] * 90)
    plan = sharding.plan_ring(dict(Counter(cells)), 7)
    got = []
    for cell, first, last, shard, _ in plan:
        got += [(cell, shard)] * (last - first + 1)
    assert sorted(got) == sorted(zip(cells, brute_ring(cells, 7), strict=True))
    grown = brute_ring(cells, 8)
    moved = np.mean([a != b for a, b in zip(brute_ring(cells, 7), grown, strict=True)])
    assert moved < 0.5


def test_shards_are_balanced_and_gapless(spark, small, odd, nothing):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        rows = sharding.shard_rows(df).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[s]) for s in range(24)]
        assert sum(sizes) == df.count() and max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(8, 0)}
    assert sharding.shard_rows(nothing).count() == 0


def test_one_repeated_id_is_ranked_in_parts(spark, tmp_path):
    rows = [(5, f"text {i % 30}") for i in range(700)] + [(5, "same")] * 500 + [(i, "x") for i in range(100)] + [(None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_rows(docs, shards=7, window_rows=90).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counted = lambda rs: Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rs)
    assert counted(got) == counted(sharding.shard_rows(docs, shards=7).collect())
    assert Counter(r["size"] for r in got) == Counter(len((t or "").encode()) + 8 for _, t in rows)
    sharding.write_shards(docs.withColumn("slot", F.lit("mine")), f"file://{tmp_path}/shards", shards=7)
    back = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(rows)


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, small):
    rows = packing.op9_swap_packing(spark, small).collect()
    used = check_packing(rows, 4096)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert {r["doc_id"] for r in rows} == {r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}


def test_pieces_equal_the_tokenizers_library(spark, small, odd):
    import zlib

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocab.path(vocab.WORD_BPE))
    lib.no_padding()
    lib.no_truncation()
    for df in (spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), odd.select("doc_id", "text")):
        want = Counter()
        for doc_id, text in df.collect():
            ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            for k, at in enumerate(range(0, len(ids), 4096)):
                part = ids[at : at + 4096]
                want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
        runs = [packing.pack_documents(df, vocab.path(vocab.WORD_BPE)).collect() for _ in range(2)]
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in runs[0]) == want
        assert Counter(map(tuple, runs[0])) == Counter(map(tuple, runs[1]))


def test_packing_cases(spark, odd, nothing):
    rows = packing.pack_documents(odd, vocab.path(vocab.WORD_BPE), group_pieces=5).collect()
    check_packing(rows, 4096)
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert len(long) > 1 and all(s == 4096 * p for p, s, _ in long) and all(n == 4096 for _, _, n in long[:-1])
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert packing.pack_documents(nothing, vocab.path(vocab.WORD_BPE)).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(20, 60, 60)
        first = packing.best_fit(lengths, 100)
        search = packing.LocalSearch(lengths, first, 100)
        before = (search.fill**2).sum()
        bins = search.run()
        assert len(bins) <= len(first) and (search.fill**2).sum() >= before
        assert sorted(i for b in bins for i in b) == list(range(60)) and all(lengths[b].sum() <= 100 for b in bins)
    # 6+2+2, 5+3+2 fill two bins where best fit decreasing opens three.
    assert len(packing.pack(np.array([5, 5, 4, 3, 3]), 10)) == 2


def improvable(lengths, bins, capacity):
    """Whether some move, one-for-one or two-for-one exchange of two bins raises the sum of squared fills, tried one by one."""
    sizes = [[int(lengths[i]) for i in b] for b in bins]
    for a, b in itertools.permutations(sizes, 2):
        pairs = lambda x: {p + q for p, q in itertools.combinations(x, 2)}
        steps = itertools.chain(itertools.product(a, {0, *b, *pairs(b)}), itertools.product(pairs(a), b))
        if any(max(0, sum(a) - sum(b)) < out - back <= capacity - sum(b) for out, back in steps):
            return True
    return False


def test_local_search_ends_at_an_optimum():
    # Best fit makes 5+5, 4+4, 3+3+3; the emptiest bin alone is soon stuck, the others reach the least number.
    assert len(packing.pack(np.repeat([5, 4, 3], [4000, 4000, 8000]), 10)) == 6000
    rng = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(rng.choice([10, 30, 100]))
        low = int(rng.integers(1, capacity // 3))
        lengths = rng.integers(low, rng.integers(low + 1, capacity * 2 // 3 + 2), rng.integers(1, 50))
        bins = packing.pack(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= capacity for b in bins)
        assert lengths.sum() > (len(bins) - 1) * capacity or not improvable(lengths, bins, capacity)


def test_top_k_small_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)] + [(91, None), (92, [1.0, None]), (93, [float("nan")]), (94, [float("inf")]), (95, [0.5]), (None, [1.0] * 6), (20, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, k=7, block_rows=8, chunk_blocks=4, group_queries=3, centres=5).orderBy("query_id", "rank", "vec_id").collect()]
    sound = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(int)) for i, v in rows if i is not None and i not in (91, 92, 93, 94)]
    sound = [(i, np.pad(v, (0, 6 - len(v)))) for i, v in sound]
    ids = sorted({i for i, _ in sound if i % 20 == 0} - {20})
    both = [v for i, v in sound if i == 20]
    twice = [sorted((-int(v @ x), i) for i, x in sound if i != 20)[:7] for v in both]
    assert sorted((r, -s, i) for a, r, i, s in got if a == 20) == sorted((r + 1, s, i) for t in twice for r, (s, i) in enumerate(t))
    for q in ids:
        v = next(x for i, x in sound if i == q)
        want = sorted(((-int(v @ x), i) for i, x in sound if i != q))[:7]
        assert [(s, i) for a, _, i, s in got if a == q] == [(-s, i) for s, i in want]
    assert topk.top_k(df.where("vec_id > 1000")).count() == 0


def test_huge_components_are_exact(spark):
    """Scores beyond what doubles hold, and sums that leave the longs on the way; beyond a long there is an error."""
    rows = [(20, [600000.0, 1.0]), (1, [600000.0, 2.0]), (2, [700000.0, 0.0]), (3, [-3e5, 2.0**-6])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1720320000000000), (1, 1474560000008192), (3, -737279999999936)]
    big = float(2**40)
    rows = [(20, [big, big, 1.0]), (1, [big, -big, 3.0]), (2, [big, -big, 2.0]), (4, [0.0, 0.0, -1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 3 * 4096), (2, 2 * 4096), (4, -4096)]
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(spark.createDataFrame([(20, [big]), (1, [big])], "vec_id long, embedding array<double>")).collect()
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(spark.createDataFrame([(20, [3e38]), (1, [1.0])], "vec_id long, embedding array<float>")).collect()


def test_each_query_goes_by_its_own_bounds():
    """A query scores exactly the blocks, in the order of its bounds, that can still reach its k-th score."""
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.integers(-3, 3, (16, 4)) + rng.integers(-30, 30, 4) for _ in range(40)]).astype(float)
    q = rng.integers(-9, 9, (5, 4)).astype(float)
    visited = []
    parts = [rows[a : a + 16] for a in range(0, 640, 16)]
    bound = topk.bounds(q, np.stack([r.max(0) for r in parts]), np.stack([r.min(0) for r in parts]))
    seen = [topk.score_blocks(q[[i]], np.full(1, -1), np.full(1, -np.inf), [Logged((np.arange(16) + 16 * b, r), visited, b) for b, r in enumerate(parts)], bound[[i]], 3, stride=1) for i in range(5)]
    at = 0
    for i in range(5):
        order, tops = np.argsort(-bound[i], kind="stable"), []
        for b in order:
            if len(tops) == 3 and bound[i, b] < tops[-1]:
                break
            assert visited[at] == b
            at += 1
            tops = sorted([*tops, *(parts[b] @ q[i])], reverse=True)[:3]
        assert seen[i][2].tolist() == tops
    assert at == len(visited) < 5 * 40


class Logged(tuple):
    """(ids, rows) that notes when it is unpacked."""

    def __new__(cls, pair, log, b):
        self = super().__new__(cls, pair)
        self.log, self.b = log, b
        return self

    def __iter__(self):
        self.log.append(self.b)
        return super().__iter__()


def test_bounds_hold():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.integers(-3, 3, (64, 5)) + 20 * k for k in range(6)]).astype(float)
    blocks = [(np.arange(a, a + 32), rows[a : a + 32]) for a in range(0, 384, 32)]
    q = rng.integers(-9, 9, (7, 5)).astype(float)
    bound = topk.bounds(q, np.stack([r.max(0) for _, r in blocks]), np.stack([r.min(0) for _, r in blocks]))
    assert all(((q @ r.T).max(1) <= bound[:, b]).all() for b, (_, r) in enumerate(blocks))
    at, ids, scores = topk.score_blocks(q, np.full(7, -1), np.full(7, -1e9), blocks, bound, 4)
    for i in range(7):
        want = sorted(zip(-(rows @ q[i]), range(384), strict=True))[:4]
        assert [(-s, j) for j, s in zip(ids[at == i].tolist(), scores[at == i].tolist(), strict=True)] == want


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    x = np.repeat(centre, 60, 0) + 0.03 * rng.normal(size=(2400, 16))
    order = rng.permutation(2400)
    df = spark.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<double>")
    search = topk.Search(df, k=5, block_rows=16)
    asked = search.asked()
    visits = search.needed(asked).agg(F.sum("visits")).first()[0]
    assert visits < 0.3 * 120 * search.n_blocks
    v = np.floor(64 * x[order]).astype(int)
    got = defaultdict(list)
    for r in topk.top_k(df, k=5, block_rows=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 2400, 20):
        want = sorted((-int(v[q] @ v[j]), j) for j in range(2400) if j != q)[:5]
        assert got[q] == [(j, -s) for s, j in want]
