"""Language identification, quality rules and the quality classifier."""

from __future__ import annotations

import contextlib
import re
import threading
from collections import Counter
from zlib import crc32

import numpy as np
import psutil
import pytest

from granary.llm import langid, quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, small, odd):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        got = quality_rules.with_counts(df, ["doc_id", "text"]).collect()
        assert len(got) == df.count()
        for r in got:
            n = counts(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])


def brute_mcd(x, h=quality_rules.H, fall=quality_rules.FALL, estimate=False):
    """The same concentration steps in numpy, on one group: its distances, or (rows of the last step, mean, covariance)."""
    def low(v, q):
        return np.sort(v)[int(np.ceil(q * len(v))) - 1]

    floor = np.array(quality_rules.FLOOR)
    mean = np.array([low(c, 0.5) for c in x.T], float)
    cov = np.diag([(1.4826 * low(np.abs(c - m), 0.5)) ** 2 for c, m in zip(x.T, mean, strict=True)]) + np.diag(floor**2)
    n, logdet = 0, np.inf
    while True:
        d2 = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        bins = np.minimum(np.round(np.log1p(d2) * quality_rules.BINS), quality_rules.LAST_BIN)
        near = x[bins <= low(bins, h)]
        new = np.cov(near.T, bias=True) + np.diag(floor**2)
        if not np.linalg.slogdet(new)[1] < logdet - fall:
            return (n, mean, cov) if estimate else d2
        n, mean, cov, logdet = len(near), near.mean(0), new, np.linalg.slogdet(new)[1]


def test_every_statistic_can_reject_alone(spark):
    rng = np.random.default_rng(11)
    words = [a + b for a in ("lam", "riv", "sto", "clo", "gar", "pap") for b in ("per", "ine", "old", "ush", "ent", "ark", "ova", "ill")]
    plain = lambda n=80: " ".join(rng.choice(words, n))
    one = plain(60)
    odd = {
        900: " ".join(w * 3 for w in plain().split()),
        901: plain().replace("a", "#").replace("o", "$"),
        902: "\n".join(["ab", *(["z"] * 40), plain(300)]),
        903: plain(70) + " " + " ".join(one.split()[:33]) + " " + " ".join(one.split()[:33]),
    }
    docs = spark.createDataFrame([(i, plain(), "en", "a") for i in range(200)] + [(i, t, "en", "a") for i, t in odd.items()], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in odd)
    assert got[902]["n_dup_lines"] == 39 and got[903]["n_repeat_words"] == 66
    assert sum(not got[i]["kept"] for i in range(200)) == 0


def test_repeats_survive_hash_collisions(spark):
    """Windows whose sort keys agree in the hash bits, lying A, B, A: by brute force both A are repeats."""
    from pyspark.sql import functions as F

    high = F.shiftright(F.xxhash64(F.concat(F.lit("w"), F.col("id").cast("string")), F.lit("x"), F.lit("y")), quality_rules.POSITION_BITS)
    pairs = spark.range(600_000).select("id", high.alias("h")).groupBy("h").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1).limit(8).collect()
    assert len(pairs) >= 3
    fill = " ".join(f"f{i}" for i in range(60))
    texts = []
    for k, r in enumerate(pairs):
        a, b = (f"w{i}" for i in sorted(r["ids"])[:2])
        for one, two in ((a, b), (b, a)):
            texts.append((2 * k, f"{one} x y m {two} x y n {one} x y {fill}"))
            texts.append((2 * k, f"{one} x y m {two} x y n {one} x y m {two} x y {fill} {two} x y"))
    got = quality_rules.with_counts(spark.createDataFrame(texts, "doc_id long, text string"), ["text"]).collect()
    assert all(r["n_repeat_words"] == counts(r["text"])[4] >= 6 for r in got)


def test_long_text_counts(spark):
    rng = np.random.default_rng(0)
    text = " ".join(f"w{i}" for i in rng.integers(0, 60, 300_000)) + " tail of it"
    got = quality_rules.with_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["text"]).first()
    assert got["n_repeat_words"] == counts(text)[4]


def test_distances_equal_numpy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en'")
    got = quality_rules.judge(docs.withColumn("source", docs["lang"]), ["doc_id"]).collect()
    vec = {r["doc_id"]: [r[s] for s in quality_rules.STATS] for r in quality_rules.with_vectors(quality_rules.with_counts(docs, ["doc_id"])).collect()}
    rows = [r for r in got if not r["base_failed"]]
    assert len(rows) >= 60
    d2 = brute_mcd(np.array([vec[r["doc_id"]] for r in rows], float))
    bins = np.round(np.log1p(d2) * quality_rules.BINS)
    scale = max(1.0, (np.exp(np.sort(bins)[int(np.ceil(0.5 * len(bins))) - 1] / quality_rules.BINS) - 1) / quality_rules.MEDIAN)
    assert np.allclose([r["distance"] for r in rows], d2 / scale, rtol=1e-6, atol=1e-9)
    assert all(r["kept"] == (r["distance"] <= quality_rules.CUT) for r in rows)


def test_small_groups_lean_on_larger_ones(spark):
    rng = np.random.default_rng(7)
    words = ["lamp", "river", "stone", "cloud", "garden", "paper", "window", "table", "horse", "yellow"]
    plain = lambda: " ".join(rng.choice(words, 80))
    rows = [(i, plain(), "en", "a") for i in range(80)] + [(100 + i, plain(), "xx", "b") for i in range(5)] + [(200, plain().replace("a", "#$"), "xx", "b"), (201, plain().replace("a", "#$"), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    judged = [r for r in got.values() if not r["base_failed"]]
    assert len(judged) >= 80 and all(r["distance"] is not None for r in judged)
    assert not got[200]["base_failed"] and not got[200]["kept"] and not got[201]["kept"]
    assert all(got[100 + i]["kept"] for i in range(5) if not got[100 + i]["base_failed"])
    few = quality_rules.judge(docs.where("lang = 'xx'"), ["doc_id"]).where("not base_failed").collect()
    assert len(few) > 2 and all(r["distance"] is not None for r in few)
    assert all(r["kept"] for r in few if r["doc_id"] < 200)


def test_leaning_estimates_equal_numpy(spark):
    """Groups of 3 to 40 rows under two languages, against the same weights in numpy."""
    rng = np.random.default_rng(3)
    rows = [(f"={lng}\x1f={src}", f"={lng}", *[int(v) for v in rng.normal((400, 50 * (lng == "b"), 20, 30), (12, 90, 60, 80))]) for lng, src, n in (("a", 1, 40), ("a", 2, 3), ("b", 1, 7), ("b", 3, 12)) for _ in range(n)]
    levels = [(g, p, *x) for pair, lng, *x in rows for g, p in ((pair, lng), (lng, quality_rules.EVERY), (quality_rules.EVERY, None))]
    df = spark.createDataFrame(levels, "grp string, parent string, " + ", ".join(f"{c} long" for c in quality_rules.STATS))
    got = {r["grp"]: r for r in quality_rules.mcd_estimates(df).collect()}

    def lean(grp):
        x = np.array([r[2:] for r in levels if r[0] == grp], float)
        n, mean, cov = brute_mcd(x, estimate=True)
        parent = next(r[1] for r in levels if r[0] == grp)
        if parent is None:
            return mean, cov
        w, (up, wide) = n / (n + quality_rules.PRIOR_ROWS), lean(parent)
        return w * mean + (1 - w) * up, w * cov + (1 - w) * wide

    for grp, r in got.items():
        mean, cov = lean(grp)
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose([r[f"m{i}"] for i in range(4)], mean) and np.allclose(low @ low.T, cov)
        assert r["scale"] >= 1


def test_rules_on_labels_and_odd_tables(spark, odd, nothing):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r[0] for r in quality_rules.kept_documents(docs).select("doc_id").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    short = {r["doc_id"] for r in docs.collect() if counts(r["text"])[0] < 50}
    assert all(r["doc_id"] in kept for r in labels if r["quality"] == 1 and r["doc_id"] not in short)
    assert not any(r["doc_id"] in kept for r in labels if r["quality"] == 0)
    assert quality_rules.judge(odd, ["doc_id", "score"]).count() == odd.count()
    clash = docs.select("*", docs["doc_id"].alias("key"), docs["doc_id"].alias("kept"), docs["doc_id"].alias("good"))
    out = quality_rules.kept_documents(clash)
    assert out.columns == clash.columns and {r["kept"] for r in out.collect()} == kept
    assert quality_rules.kept_documents(odd).columns == odd.columns
    assert quality_rules.judge(nothing, ["doc_id"]).count() == 0


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 30):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k
        assert all(len(set(c)) == 2 for c in code.T)
    assert langid.codewords(4).shape == (4, 7) and langid.codewords(1).shape == (1, 1)


def test_langid_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in langid.op5_ecoc_langid(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    held = [r for r in docs if crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] == (r in held) for r in docs[:50])
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_langid_cases(spark, odd, nothing):
    model = langid.learn(odd)
    out = langid.identify(odd, model, ["doc_id", "score", "_key"]).collect()
    assert len(out) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in out if r["doc_id"] in (3, 4, 5))
    none = langid.learn(nothing)
    assert {r["lang_pred"] for r in langid.identify(odd, none, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(nothing, model, ["doc_id"]).count() == 0
    assert langid.predict("123 456 !", model) == ("und", 0.0, False)


def test_ftrl_learns_and_stays_sparse():
    model = quality_model.Ftrl(size=64)
    rng = np.random.default_rng(0)
    for _ in range(400):
        y = int(rng.random() < 0.5)
        model.learn(np.array([1 if y else 2, int(rng.integers(3, 60))]), np.ones(2) / np.sqrt(2), y)
    w = model.all_weights()
    assert w[1] > 0.3 and w[2] < -0.3 and np.abs(w[60:63]).sum() == 0


def test_quality_model_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_model.op8_ftrl_quality(spark, folder).collect()}
    assert len(got) == docs.count()
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([s >= 0.3 for s in good]) > 0.995 and np.mean([s < 0.3 for s in bad]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_quality_model_cases(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 1)], "doc_id long, quality int")
    weights = quality_model.quality_weights(odd, labels)
    out = quality_model.score(odd, weights, ["doc_id"]).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    none = quality_model.quality_weights(odd, labels.where("doc_id = 99"))
    assert {r["score"] for r in quality_model.score(odd, none, ["doc_id"]).collect()} == {0.5}
    good = quality_model.good_documents(odd, odd, labels)
    assert good.columns == odd.columns and {r["score"] for r in good.collect()} <= {None, "x", "y"}
    assert quality_model.score(nothing, weights, ["doc_id"]).count() == 0


@pytest.mark.parametrize("text", [None, "", "one", "A a A a", "x" * 100_000, " ".join(map(str, range(80_000)))])
def test_features_are_unit_vectors(text):
    for f in (quality_model.features, langid.features):
        index, value = f(text or "")
        assert len(index) == len(set(index.tolist())) and float(value @ value) == pytest.approx(1, abs=1e-3)


def test_langid_sample_is_bounded_and_keeps_rows_apart(spark):
    rows = [(1, "hello there", "en"), (1, None, "en"), (1, "guten tag", "de")] + [(7, f"text {i}", "en") for i in range(400)] + [(9, "same words", "fr")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for limit in (30, 3000):
        got = [tuple(r) for r in langid.training_rows(docs, limit).collect()]
        assert 3 <= len(got) <= limit and len(got) == len(set(got))
        assert set(got) <= {(i, t, n) for i, t, n in rows if t is not None}
    assert langid.learn(docs)["languages"].tolist() == ["de", "en", "fr"]


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(400)] + [(8, "one"), (8, None), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    got = quality_model.labelled_sample(docs, labels).collect()
    assert sorted((r["id"], r["label"]) for r in got) == [(7, 1), (8, 0), (9, 1)]
    assert len(quality_model.labelled_sample(docs, labels, 2).collect()) == 2


def test_training_memory_does_not_grow_with_texts(spark):
    """Vectors of whole texts, all in the training task at once, took 793 MB of a worker here."""
    n, words = 500, 30_000
    sample = spark.range(n).selectExpr("id", f"array_join(transform(sequence(1, {words}), i -> cast(id * {words} + i as string)), ' ') as text", "cast(id % 2 as int) as label")
    first, most, done = {}, {}, threading.Event()

    def watch():
        while not done.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                with contextlib.suppress(psutil.Error):
                    if "pyspark.daemon" in " ".join(p.cmdline()):
                        now = p.memory_info().rss / 1e6
                        most[p.pid] = max(most.get(p.pid, 0), now - first.setdefault(p.pid, now))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        weights = quality_model.train(sample, epochs=1)
    finally:
        done.set()
        watcher.join()
    assert np.count_nonzero(weights) and max(most.values()) < 350


def test_training_equals_whole_vectors_in_order(spark):
    texts = {i: " ".join(f"w{i % 7}x{k * k % (500 + 97 * i)}" for k in range(400 * i)) for i in range(8)}
    rows = [(i, t or None, i % 2) for i, t in texts.items()]
    model = quality_model.Ftrl()
    for _ in range(2):
        for _, t, y in sorted(rows, key=lambda r: crc32(str(r[0]).encode())):
            model.learn(*quality_model.features(t), y)
    got = quality_model.train(spark.createDataFrame(rows, "id long, text string, label int"), epochs=2)
    assert np.array_equal(got, model.all_weights().astype("<f4").astype(np.float64))


def test_good_documents_send_texts_once(spark, odd):
    """Python gets the texts alone and gives numbers back; texts and other columns stay where they are."""
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")
    plan = quality_model.good_documents(odd, odd, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_ftrl_equals_plain_updates():
    """The sparse vectorised updates against the rule written out for one coordinate at a time."""
    rng = np.random.default_rng(4)
    model, size = quality_model.Ftrl(size=9), 9
    a, b, l1, l2 = quality_model.ALPHA, quality_model.BETA, quality_model.L1, quality_model.L2
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        one, two = (0, 0) if i == size - 1 else (l1, l2)
        return 0.0 if abs(z[i]) <= one else -(z[i] - np.sign(z[i]) * one) / ((b + n[i] ** 0.5) / a + two)

    for _ in range(200):
        index = rng.choice(size - 1, 3, replace=False)
        value, label = rng.random(3), int(rng.random() < 0.4)
        model.learn(index, value, label)
        x = dict(zip([*index.tolist(), size - 1], [*value.tolist(), 1.0], strict=True))
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            g, w = (p - label) * v, weight(i)
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w
            n[i] += g * g
    assert np.allclose(model.all_weights(), [weight(i) for i in range(size)])


def test_langid_decoding_equals_plain_loops():
    texts = ["the cat sat here", "a dog is there", "le chat est la", "un chien est ici", "der hund ist da", "die katze war hier"] * 3
    model = langid.fit(texts, ["en", "en", "fr", "fr", "de", "de"] * 3)
    assert model["languages"].tolist() == ["de", "en", "fr"] and np.allclose(model["trust"].sum(1), 1)
    for text in ["the dog", "le chien", "die", "x", "la katze est here"]:
        index, value = langid.features(text)
        dense = np.zeros(2 << langid.BITS)
        for i, v in zip(index, value, strict=True):
            dense[i] = v
        loss = []
        for k in range(3):
            total = 0.0
            for bit in range(model["code"].shape[1]):
                f = float(model["bias"][bit]) + sum(float(dense[i]) * float(model["w"][i, bit]) for i in index)
                total += model["trust"][k, bit] * np.log1p(np.exp(-model["code"][k, bit] * f)) * model["code"].shape[1]
            loss.append(total)
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        best = sorted(range(3), key=lambda k: loss[k])
        got = langid.predict(text, model)
        assert got[0] == model["languages"][best[0]] and got[1] == pytest.approx(share[best[0]], abs=1e-5) and got[2] == (share[best[1]] > langid.CLOSE)


def test_langid_fit_descends_to_plain_gradient_steps():
    """The weights after the fixed rounds against the same steps taken text by text and bit by bit."""
    texts, names = ["ab ba", "abab", "xy yx", "xyxy x"], ["p", "p", "q", "q"]
    model = langid.fit(texts, names)
    code = model["code"]
    feats = [dict(zip(*(a.tolist() for a in langid.features(t)), strict=True)) for t in texts]
    for bit in range(code.shape[1]):
        w, v, b, vb = Counter(), Counter(), 0.0, 0.0
        for _ in range(langid.ROUNDS):
            grad, gb = Counter(), 0.0
            for x, n in zip(feats, names, strict=True):
                y = code["pq".index(n), bit]
                pull = -y / 4 / (1 + np.exp(y * (sum(w[i] * c for i, c in x.items()) + b)))
                for i, c in x.items():
                    grad[i] += pull * c
                gb += pull
            for i in {*w, *grad}:
                v[i] = 0.9 * v[i] + grad[i] + langid.DECAY * w[i]
            vb = 0.9 * vb + gb
            for i in v:
                w[i] -= langid.RATE * 0.1 * v[i]
            b -= langid.RATE * 0.1 * vb
        assert all(abs(model["w"][i, bit] - w[i]) < 2e-3 * max(1, abs(w[i])) for i in w) and abs(model["bias"][bit] - b) < 2e-3 * max(1, abs(b))


def test_langid_learns_a_bounded_number_of_languages(spark):
    rows = [(i, f"text {i}", f"l{i % 40:02d}" if i < 400 else "l07") for i in range(1, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(docs, 100, 5).collect()
    names = {r["name"] for r in got}
    assert len(names) == 5 and "l07" in names
    assert len(got) <= 100
