"""Odd inputs of the corpus operators and the pipeline, and results against plain forms of the models."""

import collections
import hashlib
import math
import pathlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldlog.llm import attention_lm, bpe, common, cws, jaccard, langid, packing, quality, substrings, toxicity, warc
from foldlog.llm.store import _written, drop, stored, swept

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def nulls(spark):
    """Null ids (a third of the rows), repeated rows, ids with several texts, null and blank texts, one long text, and columns that clash with helpers' names."""
    rng = random.Random(20)
    rows = [(None, some(rng, 60)) for _ in range(20)] + [(5, some(rng, 60))] * 6 + [(6, some(rng, 60)), (6, some(rng, 60)), (7, None), (8, ""), (9, " \n "), (10, some(rng, 9000))] + [(20 + i, some(rng, 60)) for i in range(20)]
    extra = {c: F.lit(3) for c in ("__text_hash", "own_0", "own_1", "__own_hash", "__cut_id", "node", "range", "row", "at", "kind", "a", "b", "text_hash")}
    return spark.createDataFrame([(i, t, "xx", "s", None) for i, t in rows], DOCS).withColumns(extra).repartition(3)


def test_blocks_have_bounded_bytes():
    rng = random.Random(21)
    texts = ["x" * rng.randrange(0, 3000) for _ in range(300)] + ["y" * 50_000, "", "z" * 10]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    found = list(common.blocks([batch.slice(0, 200), batch.slice(200, 0), batch.slice(200)], 10_000))
    assert [t for b in found for t in common.texts(b)] == texts
    assert all(b.nbytes <= 11_000 or b.num_rows == 1 for b in found) and len(found) > 20


def test_word_hashes_do_not_depend_on_the_cuts(monkeypatch):
    rng = random.Random(22)
    texts = [" \t".join("".join(rng.choices("abcé \n", k=rng.randrange(0, 30))) for _ in range(40)).encode() for _ in range(20)] + [b"", b"q" * 5000, b" " * 700, b"r" * 300 + b" end"]
    h, at = substrings.word_hashes(texts, 2)
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    by = collections.defaultdict(set)
    for w, x in zip([w for t in texts for w in t.split()], map(tuple, h.tolist()), strict=True):
        by[w].add(x)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    for size in (64, 999):
        monkeypatch.setattr(substrings, "AT_ONCE", size)
        substrings._tables.cache_clear()
        again, places = substrings.word_hashes(texts, 2)
        assert (again == h).all() and (places == at).all()
    substrings._tables.cache_clear()


def test_samples_do_not_follow_null_ids_or_repeats(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = rows.union(rows.where("doc_id = 1").crossJoin(spark.range(500)).select("doc_id", "text"))
    n = common.sampled(rows, 0.1, 3).count()
    assert 450 < n < 750


def test_tables_go_when_they_are_read(spark):
    a = stored(spark.range(5))
    b = stored(a.selectExpr("id * 2 AS id"), a)
    assert a.stored_at not in _written and b.stored_at in _written and [r.id for r in b.orderBy("id").collect()] == [0, 2, 4, 6, 8]
    drop(b, spark.range(3))
    assert b.stored_at not in _written


def test_chance_meetings_of_the_jaccard_join_are_sifted(spark):
    """Sets that share half of their shingles meet in some parts, and don't link; those that link stay, or are members of crowded parts."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        common_part = some(rng, 60, 5000)
        family = [common_part + " " + some(rng, 50, 5000) for _ in range(6)]
        texts += family + [family[0] + " tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    values, at = jaccard.shingles([t.encode() for t in texts])
    nodes, sets = jaccard.set_hash(values, at).view(np.int64).tolist(), [set(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    linked = {tuple(sorted((nodes[i], nodes[j]))) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    met = stored(jaccard.meet(df, int(at[-1])))
    before = {(r.a, r.b) for r in met.where("crowd = 0").collect()}
    pairs, members = jaccard.sifted(met)
    after, members = {(r.a, r.b) for r in pairs.where("often").collect()}, {r.node for r in members.collect()}
    assert len(linked) == 12 and all(p in after or members.issuperset(p) for p in linked)
    assert after <= before and len(before) > 100 and len(after) < len(before) / 2


def test_shuffles_of_the_jaccard_join_go_step_by_step(spark, monkeypatch):
    """When texts are moved to be verified, the shuffles of all steps before are gone: those of posts are larger than the input."""
    rng = random.Random(31)
    texts = [some(rng, rng.randrange(30, 60), 60) for _ in range(60)]
    texts += [t + " tail" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    left, verified = [], jaccard.verified

    def looked(*args):
        for _ in range(30):  # files go a little after the plans
            if not known.size():
                break
            time.sleep(0.1)
        left.append(known.size())
        return verified(*args)

    swept(df)  # what other tests have left
    monkeypatch.setattr(jaccard, "verified", looked)
    out = {r.doc_id: r.component_id for r in jaccard.join(df).collect()}
    assert len(left) == 3 and max(left) <= 3
    assert sum(out[i + 60] == i for i in range(60)) > 50


def test_language_model_leaves_little_on_disk(spark, monkeypatch):
    """Bytes of the tables that blocks and buckets keep, by word and by distinct word of a block; the shuffle of what buckets were sent is gone when texts meet their counts."""
    rng = random.Random(41)
    texts = [" ".join(f"w{int(rng.paretovariate(0.3)) % 10**6}" for _ in range(500)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    model = attention_lm.new_model(np.ones(max(ranks.values()) + 2), attention_lm.begins_word(ranks)) | {"tokens": 0}
    model["n"][:, :-1] = np.random.default_rng(41).normal(0, 0.3, model["n"][:, :-1].shape)
    monkeypatch.setattr(attention_lm, "fit", lambda *a: model)
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    sizes, left, base_scores = [], [], attention_lm.base_scores

    def kept(table, *done):
        out = stored(table, *done)
        sizes.append(sum(x.stat().st_size for x in pathlib.Path(out.stored_at.removeprefix("file:")).glob("*.parquet")))
        return out

    def looked(*args):
        for _ in range(30):  # files go a little after the plans
            if not known.size():
                break
            time.sleep(0.1)
        left.append(known.size())
        return base_scores(*args)

    swept(df)  # what other tests have left
    monkeypatch.setattr(attention_lm, "stored", kept)
    monkeypatch.setattr(attention_lm, "base_scores", looked)
    out = attention_lm.score(df, F.col("doc_id") % 5 != 0, ranks, P.PATTERN).collect()
    lists = [t.split() for t in texts]
    counts = collections.Counter(w for i, x in enumerate(lists) if i % 5 for w in x)
    assert len(out) == 200 and all(r.n_known == sum(w in counts for w in lists[r.doc_id]) + 1 for r in out)
    n, distinct = sum(map(len, lists)), len({w for x in lists for w in x})
    assert sizes[0] < 4 * n + 12 * distinct and sizes[1] < 4 * distinct
    assert left[0] <= 2  # those of two sums


def test_jaccard_join_moves_the_texts_of_near_sets_only(spark, monkeypatch):
    """Sets that share half of their shingles meet by chance; what their sketches tell apart is known before their texts are moved."""
    rng = random.Random(37)
    part = some(rng, 25, 5000)
    texts = [f"{part} {some(rng, 25, 5000)}" for _ in range(60)]
    near = [some(rng, 60, 5000) for _ in range(4)]
    texts += [x for t in near for x in (t, t + " tail")]
    met, moved, narrowed, verified = [], [], jaccard.narrowed, jaccard.verified
    monkeypatch.setattr(jaccard, "narrowed", lambda pairs, known: met.append(pairs.count()) or narrowed(pairs, known))
    monkeypatch.setattr(jaccard, "verified", lambda pairs, texts: moved.append(sorted(r.text for r in texts.collect())) or verified(pairs, texts))
    out = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert met[0] > 20 and moved[0] == sorted(texts[60:])
    assert out == {i: i if i < 60 else i - i % 2 for i in range(68)}


def test_every_operator_keeps_odd_rows(spark):
    """A result row for each row (of op10: one at least), the same for repeated rows, and no error from nulls or clashing names."""
    df = nulls(spark)
    n = df.count()
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = {
        "bpe": bpe.encode_documents(df, ranks, P.PATTERN),
        "lm": attention_lm.score(df, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)), ranks, P.PATTERN),
        "cws": cws.fingerprints(df),
        "lang": langid.identify(df, langid.fit(df)),
        "quality": quality.assess(df, labels).drop("anomaly"),
        "jaccard": jaccard.join(df),
        "substrings": substrings.dedup(df),
        "toxic": toxicity.score(df, toxicity.fit(df, labels)),
    }
    for name, rows in out.items():
        rows = rows.collect()
        assert len(rows) == n, name
        assert len({tuple(r) for r in rows if r.doc_id == 5}) <= (2 if name == "cws" else 1), name  # the last of repeated rows has another next row
        assert sum(r.doc_id is None for r in rows) == 20, name
    pieces = packing.pack(df, packing.default_spec()).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == collections.Counter(r.doc_id for r in df.collect())
    kept = [jaccard.keep_one(df), substrings.remove(df), quality.keep_good(df, labels), toxicity.keep_clean(df, toxicity.fit(df, labels))]
    for x in kept:
        assert x.columns == df.columns and x.count() <= n


def test_language_scores_by_plain_means(spark):
    rng = random.Random(23)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ün", "ter"], "cc": ["que", "é", "oi"]}
    rows = [(i, " ".join("".join(rng.choices(s, k=3)) for _ in range(rng.randrange(1, 20))), lang) for i in range(240) for lang, s in [rng.choice(list(syllables.items()))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 2"))
    right = 0
    for r in langid.identify(df, model).collect():
        _, text, lang = rows[r.doc_id]
        total, n = np.zeros(len(model["labels"])), 0
        for w in text.lower().encode().split():
            buckets, _ = langid.word_features([w])
            total, n = total + model["parts"][buckets].sum(axis=0, dtype=np.float64), n + len(buckets)
        p = np.exp(total / n - (total / n).max())
        p /= p.sum()
        assert r.lang_pred == model["labels"][int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-4)
        right += r.doc_id % 4 == 2 and r.lang_pred == lang
    assert right >= 0.97 * 60  # held out
    assert langid.BUCKETS & (langid.BUCKETS - 1) == 0


def marked(spark, n):
    rng = random.Random(24)
    texts, marks = [], []
    for i in range(n):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}{rng.choice('xyz')}" for _ in range(rng.randrange(30, 80))]
        bad, toxic = rng.random() < 0.15, rng.random() < 0.2
        if bad:
            w = [x + rng.choice(["###", "***", "$$$"]) for x in w]
        if toxic:
            for k in range(0, len(w), 12):
                w[k] = rng.choice(["Vile,", "nasty", "rotten!"])
        texts.append(" ".join(w))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks, texts


def test_quality_by_plain_paths(spark):
    """Anomaly and verdict from a walk down each tree; and documents whose labels the forest didn't see are judged as well."""
    df, labels, marks, texts = marked(spark, 600)
    known = labels.where("doc_id % 3 <> 0")
    stats = quality.measured(df, ["doc_id"])
    model = quality.fit(stats, known)

    def length(tree, row, at=0):
        f, cut, left, right = tree[at]
        return cut if f < 0 else length(tree, row, int(left if row[int(f)] < cut else right))

    held = [0, 0]
    for r in quality.judge(stats, model, ["doc_id"]).collect():
        s = quality.statistics([texts[r.doc_id].encode()])
        x, worst = quality.features(s)[0], 0.0
        for columns, trees, rows, cut in model:
            if math.isfinite(cut):
                mean = sum(length(t.tolist(), x[columns]) for t in trees) / len(trees)
                worst = max(worst, 2 ** (-mean / float(quality.mean_path(rows))) / cut)
        assert r.anomaly == pytest.approx(worst, abs=1e-9) and r.kept == (not r.base_failed and worst < 1)
        if r.doc_id % 3 == 0:
            held[0] += 1
            held[1] += r.kept == bool(marks[r.doc_id][1])
    assert held[1] >= 0.97 * held[0]


def test_quality_threshold_by_counts():
    """The cut from histograms equals the one from sorted scores."""
    rng = np.random.default_rng(25)
    good, bad = np.zeros(quality.STEPS + 1, np.int64), np.zeros(quality.STEPS + 1, np.int64)
    g, b = rng.integers(3000, 6000, 9000), rng.integers(5800, 8000, 400)
    np.add.at(good, g, 1)
    np.add.at(bad, b, 1)
    least = np.sort(g)[-1 - int(9000 * quality.SPARE)]
    assert quality.threshold(good, bad) == (2 * (least + 1) + min(x - least - 1 for x in b.tolist() if x > least)) / 2 / quality.STEPS
    assert quality.threshold(good, np.zeros_like(bad)) == quality.threshold(np.zeros_like(good), bad) == float("inf")


def test_toxicity_by_plain_sums(spark):
    df, labels, marks, texts = marked(spark, 500)
    model = toxicity.fit(toxicity.learnable(df), toxicity.learnable(labels))
    weights = dict(zip(model["codes"].tolist(), model["weights"].tolist(), strict=True))
    held = [0, 0]
    for r in toxicity.score(df, model).collect():
        f = model["bias"] + sum(weights.get(c, 0.0) for c in set(toxicity.codes_of(texts[r.doc_id].lower())))
        assert r.score == pytest.approx(1 / (1 + math.exp(-f)), abs=1e-9) and r.predicted == int(r.score >= 0.5)
        if (__import__("zlib").crc32(str(r.doc_id).encode()) % 5) == 0 and marks[r.doc_id][2]:
            held[0] += 1
            held[1] += r.predicted
    assert held[0] > 5 and held[1] >= 0.9 * held[0]


def test_archive_blocks_of_all_kinds(spark):
    """Real header blocks, references of all kinds, blocks without an empty line or status, very long ones."""
    head = "HTTP/1.1 301 Moved\r\nDate: Mon, 1 Jan 2024 00:00:00 GMT\r\nContent-Type: text/html\r\nSet-Cookie: a=b; c\r\nSet-Cookie: d=e\r\nLocation: http://b/\r\n\r\n"
    html = "<p>&#8217;&#x2014;&eacute;&amp;lt;&nbsp;&copy; &bogus; &#0; &#xD800; &#1114112; AT&T; &CounterClockwiseContourIntegral; fish & chips &amp"
    rows = [(1, "<r1>", "http://a/", "2024-01-01T00:00:00Z", head + html, None), (2, "<r2>", "u", None, "no empty line", "sha256:given"), (3, None, None, None, None, None), (4, "<r4>", "u", "d", "HTTP/1.1 200 OK\r\n\r\n" + "a&amp;" * 200_000, None), (5, "<r5>", "u", "d", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + "<b>a&amp;</b> " * 50_000, None)]
    df = spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, date string, block string, block_digest string")
    out = {(r.page_id, r.warc_type): r for r in warc.derive(df).collect()}
    assert len(out) == 10
    meta = out[1, "metadata"].block
    for line in ("source-Date: Mon, 1 Jan 2024 00:00:00 GMT", "source-Content-Type: text/html", "source-Set-Cookie: a=b; c", "source-Set-Cookie: d=e", "source-Location: http://b/", "http-status: 301"):
        assert f"{line}\r\n" in meta
    assert meta.index("a=b; c") < meta.index("d=e")
    assert out[1, "conversion"].block == "’—é&lt; © &bogus; &#0; &#xD800; &#1114112; AT&T; ∳ fish & chips &amp"
    whole = "sha256:" + hashlib.sha256((head + html).encode()).hexdigest()
    assert out[1, "conversion"].source_block_digest == whole and f"WARC-Source-Block-Digest: {whole}\r\n" in out[1, "conversion"].headers
    assert "WARC-Date: 2024-01-01T00:00:00Z\r\n" in out[1, "metadata"].headers and "WARC-Refers-To-Date: 2024-01-01T00:00:00Z\r\n" in out[1, "metadata"].headers
    assert out[2, "conversion"].block == "" and out[2, "metadata"].source_block_digest == "sha256:given" and "http-status: \r\n" in out[2, "metadata"].block
    assert out[3, "conversion"].content_length == 0 and out[4, "conversion"].content_length == 6 * 200_000
    assert out[5, "conversion"].block == " ".join(["a&"] * 50_000)


def test_stages_on_odd_tables(spark, tmp_path):
    """Each stage on nulls, repeats and clashing columns, on an empty table, and run() on a table without rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    df = nulls(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        ids = collections.Counter(r.doc_id for r in out.collect())
        assert ids[10] and (ids[None] == 20 or stage is pipeline.reject_low_quality), stage.__name__
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, stage.__name__
        assert out.columns == df.columns or stage is pipeline.pack
    df.select(*[c.split()[0] for c in DOCS.split(", ")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
