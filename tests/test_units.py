"""Small cases of functions whose results are known."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import prob as P
from granary.functions import text as T
from granary.operators import generators as G
from granary.operators import sampling as S
from granary.operators import stats as X
from granary.operators.dedup import PRIME, coefficients, minhash, minhash_in_columns
from granary.operators.filters import first_reason, licence_max
from granary.operators.overlap import jaccard_join
from granary.operators.tree import node_depths
from granary.plans.mixture import Mixture
from granary.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_shingles(spark):
    t = T.tokens(F.lit("The 3 Cats, the cat!"))
    assert one(spark, t) == ["the", "3", "cats", "the", "cat"]
    assert one(spark, T.shingles(t, 4)) == ["the 3 cats the", "3 cats the cat"]
    assert one(spark, T.shingles(t, 6)) == []
    assert one(spark, T.shingles(T.tokens(F.lit(None).cast("string")), 2)) == []
    assert one(spark, T.masked_shingles(F.lit("1 2 3 4 a b"), 4)) == ["# # a b"]


def test_cuts_and_answers(spark):
    assert one(spark, T.head_tail(F.lit("abcdefghij"), 6)) == "abcd [...] ij"
    assert one(spark, T.head_tail(F.lit("abc"), 6)) == "abc"
    assert one(spark, T.before_last(F.lit("a?b?c"), "?")) == "a?b"
    assert one(spark, T.answer_letter(F.lit("answer: A\nso answer: (C)"))) == "C"
    assert one(spark, T.answer_letter(F.lit("answer: A</think> B"))) == "B"
    assert one(spark, T.answer_letter(F.lit("none here"))) is None
    assert one(spark, T.numbers(F.lit("1,200 and -3.5"))) == [1200.0, -3.5]


def test_bins_at_their_edges(spark):
    right = lambda x: one(spark, P.bin_right_closed(F.lit(x)))
    left = lambda x: one(spark, P.bin_left_closed(F.lit(x)))
    assert [right(x) for x in (0.0, 1 / 15, 1 / 15 + 1e-9, 1.0)] == [0, 0, 1, 14]
    assert [left(x) for x in (0.0, 0.1, 0.999, 1.0)] == [0, 1, 9, 9]


def test_probabilities(spark):
    p = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))
    assert one(spark, P.brier(p, F.lit(0))) == pytest.approx(0.5)
    assert one(spark, P.nll(p, F.lit(2))) == pytest.approx(-math.log(1e-12))
    assert one(spark, P.entropy(p)) == pytest.approx(math.log(2))
    assert one(spark, P.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]


def test_t_quantiles_and_exact_tests():
    assert X.t_quantile(0.975, 2) == pytest.approx(4.302652730, abs=1e-6)
    assert X.t_quantile(0.975, 30) == pytest.approx(2.042272456, abs=1e-6)
    assert X.t_cdf(0, 5) == pytest.approx(0.5)
    assert X.binomial_cdf(2, 4, 0.5) == pytest.approx(11 / 16)
    assert [X.t_cdf(x, d) for x, d in ((1, 1), (-1, 1), (2, 3), (1.5, 4))] == pytest.approx([0.75, 0.25, 0.930337, 0.896], abs=1e-6)
    assert X.t_quantile(0.975, 7) == pytest.approx(2.364624252, abs=1e-6)
    assert X.learn_then_test([(1, 0, 100), (3, 1, 100), (2, 50, 100)], 0.1, 0.05) == [3]
    assert X.isotonic(np.array([1.0, 3.0, 2.0]), np.ones(3)).tolist() == [2.0, 2.0, 2.0]


def test_mcnemar(spark):
    assert one(spark, X.mcnemar_p(F.lit(5).cast("long"), F.lit(0).cast("long"))) == pytest.approx(2 / 32)
    assert one(spark, X.mcnemar_p(F.lit(3).cast("long"), F.lit(3).cast("long"))) == 1.0


def test_pairs_needed(spark):
    need = lambda p, d: one(spark, X.pairs_needed(F.lit(p), F.lit(d)))
    assert need(0.2, 0.1) == math.ceil((1.959964 * math.sqrt(0.2) + 0.841621 * math.sqrt(0.19)) ** 2 / 0.01)
    assert need(0.2, 0.0) is None and need(0.2, 0.5) is None and need(0.25, -0.5) is None


def level_by_bisection(total, weights, limits):
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(limits[k], mid * weights[k]) for k in weights) < total else (lo, mid)
    return {k: min(limits[k], hi * weights[k]) for k in weights}


def test_allocations(spark):
    rng = np.random.default_rng(6)
    for _ in range(4):
        keys = [f"k{i}" for i in range(int(rng.integers(1, 9)))]
        w, l = ({k: float(rng.integers(1, 50)) for k in keys} for _ in range(2))
        total = float(rng.integers(1, int(sum(l.values())) + 1))
        df = spark.createDataFrame([(k, w[k], l[k], total) for k in keys], "key string, w double, l double, t double")
        got = {r["key"]: r["share"] for r in S.filled(df, "key", F.col("w"), F.col("l"), F.col("t")).collect()}
        assert got == pytest.approx(level_by_bisection(total, w, l), abs=1e-6)
    for sizes, n, want in (({"a": 1, "b": 9, "c": 9}, 10, {"a": 1, "b": 5, "c": 4}), ({"a": 3, "b": 2}, 99, {"a": 3, "b": 2}), ({"a": 4, "b": 4, "c": 4}, 2, {"a": 1, "b": 1, "c": 0})):
        df = spark.createDataFrame(list(sizes.items()), "key string, n long")
        assert {r["key"]: r["quota"] for r in S.equal_quotas(df, ["key"], n).collect()} == want


def test_hash_order_in_ranges(spark):
    from granary.functions.hashing import hash_rank_key
    from granary.functions.ranges import in_hash_order

    rows = [(i, "abn"[i % 3] if i % 3 < 2 else None, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, v long")
    got = in_hash_order(df, ["g"], hash_rank_key("s", F.col("i")), "i", 13, rank="k", size="n", before={"sum": F.col("v")}).collect()
    import hashlib

    order = sorted(rows, key=lambda r: (str(r[1]), hashlib.md5(f"s|{r[0]}".encode()).hexdigest()))
    want, at = {}, {}
    for i, g, v in order:
        k, total = at.get(g, (0, 0))
        want[i] = (k + 1, 100, total)
        at[g] = (k + 1, total + v)
    assert {r["i"]: (r["k"], r["n"], r["sum"]) for r in got} == want


def test_two_level_bootstrap_resamples_seeds(spark):
    """Seeds that disagree widen the interval, items alone do not; each draw against numpy on the same digests."""
    import hashlib

    rng = np.random.default_rng(2)
    rows = [(s, i, float(rng.random() < 0.2 + 0.3 * s)) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "seed int, item long, d double")
    got = {r["draw"]: r["m"] for r in X.two_level(df, "d", "item", "seed", 3, "x", draws=30).collect()}
    d = np.zeros((3, 40))
    for s, i, v in rows:
        d[s, i] = v
    number = lambda *p: hashlib.md5("|".join(map(str, p)).encode()).hexdigest()
    for draw in range(30):
        u = [int(number("x-items", i, draw // 4)[8 * (draw % 4) :][:8], 16) / 2**32 for i in range(40)]
        w = np.array([sum(x >= t for t in X.POISSON) for x in u])
        means = (d * w).sum(1) / w.sum()
        picks = [int(number("x-seeds", draw, j)[:8], 16) % 3 for j in range(3)]
        assert got[draw] == pytest.approx(np.mean([means[p] for p in picks]))
    assert np.std(list(got.values())) > 0.1


def test_licences_and_reasons(spark):
    assert one(spark, licence_max(F.lit("PERM"), F.lit("NC"))) == "NC"
    assert one(spark, licence_max(F.lit("PERM"), F.lit("what"))) == "UNK"
    assert one(spark, first_reason([("a", F.lit(None).cast("boolean")), ("b", F.lit(True))])) == "b"


def test_minhash_equals_python(spark):
    import zlib

    text = "one two three four five six seven"
    words = text.split()
    hashes = [zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(3)]
    a, b = coefficients()
    want = [min((x * h + y) % PRIME for h in hashes) for x, y in zip(a, b, strict=True)]
    for made in (minhash, minhash_in_columns):
        assert one(spark, made(F.lit(text))) == want
        assert one(spark, made(F.lit("too few words"))) is None and one(spark, made(F.lit(None).cast("string"))) is None


def test_jaccard_join_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    sets = [(k, sorted(rng.sample("abcdefghij", rng.randint(1, 6)))) for k in range(40)]
    df = spark.createDataFrame(sets, "a long, s array<string>")
    got = {(r["a"], r["b"]) for r in jaccard_join(df, "a", df.withColumnRenamed("a", "b"), "b", 0.6).collect()}
    want = {(i, j) for i, x in sets for j, y in sets if len({*x} & {*y}) >= 0.6 * len({*x} | {*y})}
    assert got == want


def test_node_depths(spark):
    nodes = spark.createDataFrame([([(0, []), (1, [0, 1, 9]), (2, [1]), (1, [2])],)], "n array<struct<id:bigint,parents:array<bigint>>>")
    assert nodes.select(node_depths(F.col("n")).alias("d")).first()["d"] == {0: 0, 1: 1, 2: 2}


def test_generators():
    assert G.solve_knights(2, [(0, 1, True)]) == [0, 3]
    assert G.forward_chain({"a"}, [(("a",), "b"), (("b", "not c"), "d")]) == {"a", "b"}
    assert G.forward_chain({"a"}, [(("a",), "b"), (("b", "not c"), "d")], closed=True) == {"a", "b", "d"}
    # d rests on "not c", and c on "not b": b is settled first, whatever the order of the rules.
    for rules in ([(("not c",), "d"), (("not b",), "c"), (("a",), "b")], [(("a",), "b"), (("not b",), "c"), (("not c",), "d")]):
        assert G.forward_chain({"a"}, rules, closed=True) == {"a", "b", "d"}
    with pytest.raises(ValueError, match="circle"):
        G.forward_chain(set(), [(("not p",), "q"), (("not q",), "p")], closed=True)
    assert G.run_program([("/", 0, 1)], [Fraction(1), Fraction(3)])[-1] == Fraction(1, 3)


def test_readers(spark, tmp_path):
    assert readers.schema_shape('{"a": 1, "b": [{"c": "x"}]}') == '{"a": "int", "b": [{"c": "str"}]}'
    with pytest.raises(ValueError, match="not finished"):
        readers.config_table(spark, [{"name": "TODO"}], "name string")
    df = spark.createDataFrame([("['a', 'b']",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(readers.literal_text("t")).collect()] == ["a\nb", "plain", None]
    (tmp_path / "one.json").write_text('{"k": 1}')
    assert readers.read_json_documents(spark, str(tmp_path), "k int").first()["file"] == "one"


def test_mixture_settings():
    assert Mixture().check() == []
    assert len(Mixture(gram=0, val_share=2, caps={"x": 0}).check()) == 3


def test_exact_jaccard_of_frequent_grams(spark, tmp_path):
    """Groups of nine or more, whose grams all are frequent, against all pairs."""
    from granary.operators.dedup import near_dup_exact_jaccard

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words)] * 10 + [" ".join([*words, *[f"x{k}" for k in range(k % 4)]]) for k in range(12)] + [" ".join(words[:25]), " ".join(words[3:38]), "four words are short", "four words are short", "some other text of nine words stands alone here"]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {}
    for b in grams:
        near = {a: len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams if a < b and grams[a] and grams[b]}
        near = {a: j for a, j in near.items() if j >= 0.8}
        if near:
            want[b] = (min(near), round(max(near.values()), 6))
    assert len(want) > 15
    assert {r["doc_id"]: (r["like_id"], r["jaccard"]) for r in near_dup_exact_jaccard(spark, folder).collect()} == want


def test_lsh_drop_equals_all_pairs(spark, tmp_path, monkeypatch):
    import random

    from granary.operators import dedup

    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(40)) for _ in range(90)] for _ in range(3)]
    rows = []
    for i in range(90):
        text = list(base[i % 3])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(90)] = f"w{rng.randrange(99)}"
        rows.append((i, " ".join(text), f"src{i % 4 if i % 5 else 9}"))
    rows += [(200 + i, rows[i][1], None if i % 2 else "src0") for i in range(12)]
    folder = f"file://{tmp_path}"
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{folder}/documents.parquet")
    s = {r[0]: np.array(r[1]) for r in df.select("doc_id", dedup.minhash(F.col("text"))).collect()}
    src = {i: x or "" for i, _, x in rows}
    want = {}
    for b in sorted(s):
        near = [a for a in s if a < b and a not in want and src[a] != src[b] and (s[a] == s[b]).sum() >= 0.8 * 64]
        if near:
            want[b] = min(near)
    # A dropped row drops nothing: some rows have dropped partners only.
    assert len(want) > 30 and any(b not in want and any(a in want and src[a] != src[b] and (s[a] == s[b]).sum() >= 0.8 * 64 for a in s if a < b) for b in s)
    for tile in (1024, 7):
        monkeypatch.setattr(dedup, "BAND_TILE", tile)
        assert {r["doc_id"]: r["like"] for r in dedup.lsh_near_dup_drop(spark, folder).collect()} == want


def test_budget_survives_a_restart(spark, tmp_path):
    from granary.streaming import calls

    log, path = f"file://{tmp_path}/log", f"file://{tmp_path}/budget"
    for k in range(3):
        spark.createDataFrame([(10.0,), (float(k),)], "value double").coalesce(1).write.mode("append").parquet(log)
    stream = lambda: calls.event_stream(spark, log, "value double")
    spent, n = calls.budget_stop(spark, stream(), 15.0, path)
    assert n == 2 and 20 <= spent <= 23
    assert calls.budget_stop(spark, stream(), 15.0, path) == (spent, n)
    rest, m = calls.budget_stop(spark, stream(), 1000.0, f"file://{tmp_path}/other")
    assert (rest, m) == (33.0, 3)


def test_closest_equals_all_pairs(spark, monkeypatch):
    """The nearest sets in parts, against every pair; before, all pairs that share a rare member were shuffled."""
    import random

    from granary.operators import overlap

    rng = random.Random(5)
    base = [rng.sample(range(400), rng.randint(1, 40)) for _ in range(40)]
    sets = [[*base[k % 40][: rng.randint(1, 40)], *rng.sample(range(400, 500), rng.randint(0, 4))] for k in range(160)] + [[], [7]]
    rows = [(k, s) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, s array<long>")
    left, right = df.where("doc_id % 3 <> 0"), df.where("doc_id % 3 = 0")
    for members, threshold in ((4_000_000, 0.6), (300, 0.6), (300, 0.9), (300, 0.2)):
        monkeypatch.setattr(overlap, "SENT_MEMBERS", members)
        got = {r["doc_id"]: (r["like_id"], r["jaccard"]) for r in overlap.closest(left, right, threshold).collect()}
        want = {}
        for a, s in rows:
            met = [(len({*s} & {*t}) / len({*s} | {*t}), b) for b, t in rows if a % 3 and not b % 3 and s and t]
            if near := [x for x in met if x[0] >= threshold]:
                want[a] = (min(b for _, b in near), max(j for j, _ in near))
        assert got == want and len(got) > 3
    assert overlap.closest(left, right.limit(0), 0.6).count() == 0


def test_exact_test_of_many_pairs(spark):
    """Against whole-number sums; the terms' factorials were summed anew for each term, which took the square of the pairs."""
    import time

    from granary.operators.stats import mcnemar_p

    def plain(b, c):
        n, term, total = b + c, 1, 0
        for i in range(min(b, c) + 1):
            total, term = total + term, term * (n - i) // (i + 1)
        return min(1.0, 2 * math.exp(math.log(total) - n * math.log(2)))

    cases = [(0, 0), (0, 1), (3, 0), (1, 1), (5, 9), (16, 15), (17, 40), (30, 31), (500, 560), (2900, 3100), (0, 1200), (1, 3000)]
    df = spark.createDataFrame([*cases, (99_500, 100_500), (400_000, 400_000)], "b long, c long")
    began = time.time()
    got = {(r["b"], r["c"]): r["p"] for r in df.select("b", "c", mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()}
    assert time.time() - began < 60
    for b, c in cases:
        assert math.isclose(got[b, c], plain(b, c), rel_tol=1e-9, abs_tol=1e-300), (b, c)
    # A normal tail with the correction for whole numbers.
    assert abs(got[99_500, 100_500] - math.erfc((1000 - 1) / math.sqrt(2 * 200_000))) < 1e-4 and got[400_000, 400_000] == 1


def test_shingle_hashes_and_long_texts(monkeypatch):
    """Checksums of runs made from those of words, a word past the table's length, and a text in pieces."""
    import re
    import zlib

    from granary.operators import dedup

    texts = ["one two three four five six", "a b c d", None, "", "w " * 3 + "x" * 70 + " y z q", " ".join(f"w{k * k % 97}" for k in range(500)), "a1 b2 c3 d4 e5 Ünë"]
    a, b = dedup.coefficients()
    want = []
    for t in texts:
        w = re.findall("[a-z0-9]+", t or "")
        seen = {zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(len(w) - 4)}
        want.append([min((x * h + y) % PRIME for h in seen) for x, y in zip(a, b, strict=True)] if seen else None)
    for at_once in (1 << 15, 100, 7):
        monkeypatch.setattr(dedup, "AT_ONCE", at_once)
        assert [None if s is None else s.tolist() for s in dedup.signatures(texts)] == want
    words = [w.encode() for w in "the quick brown fox jumps over a lazy dog 42".split()]
    assert dedup.shingle_hashes(words).tolist() == [zlib.crc32(b" ".join(words[i : i + 5])) for i in range(6)]


def test_rare_gram_pairs_are_packed(spark, monkeypatch):
    """Pairs by grams of few rows, packed in pieces that a gram's rows lie across; hot grams leave rows only that show them to be hot."""
    import itertools
    import random
    from collections import defaultdict

    from granary.operators import overlap

    rng = random.Random(8)
    rows = [(k if k else None, [7, *rng.sample(range(-150, 150), rng.randint(0, 6))]) for k in range(120)]
    rows[5] = (5, [])
    owners = defaultdict(list)
    for d, s in rows:
        for g in set(s):
            owners[g].append(d)
    want = {p for ds in owners.values() if 2 <= len(ds) <= 3 for p in itertools.combinations(sorted(d for d in ds if d is not None), 2)}
    df = spark.createDataFrame([(d, list(dict.fromkeys(s))) for d, s in rows], "doc_id long, s array<long>").repartition(2)
    for packed, parts in ((1_000_000, 1), (40, 5)):
        monkeypatch.setattr(overlap, "PACKED_GRAMS", packed)
        assert {tuple(r) for r in overlap.rare_gram_pairs(df, "doc_id", 3, parts).collect()} == want and len(want) > 20


def test_pairs_are_confirmed_in_parts(spark, monkeypatch):
    """Similarities of listed pairs, with partners' sets sent in many parts; before, each pair carried both sets through shuffles."""
    import itertools
    import random

    from granary.operators import dedup

    rng = random.Random(2)
    sets = {(k, -k): sorted(rng.sample(range(60), rng.randint(20, 50))) for k in range(40)}
    pairs = [(*b, *a, a[0]) for a, b in itertools.combinations(sets, 2) if rng.random() < 0.7]
    df, each = spark.createDataFrame(pairs, "h1 long, h2 long, a1 long, a2 long, there long"), spark.createDataFrame([(*k, s) for k, s in sets.items()], "h1 long, h2 long, s array<long>")
    want = {}
    for b1, b2, a1, a2, there in pairs:
        x, y = set(sets[b1, b2]), set(sets[a1, a2])
        if (j := len(x & y) / len(x | y)) >= 0.5:
            t, best = want.get((b1, b2), (there, j))
            want[b1, b2] = (min(t, there), max(best, j))
    for sent in (4_000_000, 150):
        monkeypatch.setattr(dedup, "SENT_GRAMS", sent)
        assert {(r["h1"], r["h2"]): (r["there"], r["jaccard"]) for r in dedup.confirmed(df, each, 0.5).collect()} == want and len(want) > 5
    assert dedup.confirmed(df.limit(0), each, 0.5).count() == 0
