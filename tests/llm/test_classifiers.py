"""Toxicity, quality, URLs and the pipeline."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wayfold.llm import decontaminate, quality, setjoin, substring, toxicity, url_filter
from wayfold.llm.common import written


def toy(seed=0, n=400):
    rng = random.Random(seed)
    bad = ["idiot", "worthless", "lowbrat", "scumbag"]
    syl = ["an", "ter", "lo", "wor", "mi", "sta", "id", "the", "cum", "ra", "les"]
    word = lambda: "".join(rng.choices(syl, k=rng.randint(1, 3)))
    out = []
    for _ in range(n):
        words, y = [word() for _ in range(rng.randint(5, 40))], int(rng.random() < 0.4)
        if y:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", ",", "!"])
        out.append((y, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def svm(spark):
    texts = spark.createDataFrame([(k, y, t) for k, (y, t) in enumerate(toy())], "doc_id long, grade int, text string")
    return toxicity.fit_svm(toxicity.bags_of(texts))


def top(svm, text):
    return svm.chance(float(svm.margins(toxicity.units_in(text)).max()))


def test_toxic_words_are_learnt_and_gaps_tolerated(svm):
    right = sum((top(svm, t) >= 0.3) == bool(y) for y, t in toy(1, 300))
    assert right >= 290
    for text in ("such an i d i o t", "i.d.i.o.t", "Idiot!!", "you idioot", "wortthless", "an idxiot", "idiozt", "scumqbag"):
        assert top(svm, text) >= 0.3, text
    assert top(svm, "") < 0.3 and top(svm, "ter lomi star") < 0.3


def test_toxicity_rows(spark, svm):
    rows = [(1, "the idiot"), (2, None), (2, None), (3, ""), (None, "ter " * 20_000 + "idiot"), (4, "ter lo")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, toxic string")
    got = toxicity.score_toxicity(df, svm)
    assert got.columns == ["doc_id", "toxic_score", "toxic"]
    assert sorted((str(r.doc_id), r.toxic) for r in got.collect()) == sorted([("1", True), ("2", False), ("2", False), ("3", False), ("None", True), ("4", False)])
    assert toxicity.score_toxicity(df.limit(0), svm).count() == 0


def test_without_both_labels_every_text_gets_the_share(spark):
    texts = spark.createDataFrame([(k, 0, "a word") for k in range(10)], "doc_id long, grade int, text string")
    svm = toxicity.fit_svm(toxicity.bags_of(texts))
    assert toxicity.fit_svm(toxicity.bags_of(texts.limit(0))).chance(0.0) == 0.5
    assert top(svm, "word") == top(svm, "idiot") < 0.3


def test_kernel_is_a_sum_over_shared_fours():
    (_, a, w), = toxicity.fours(["abcd"])
    assert np.isclose((w * w).sum(), 1) and a.shape == (1, 15)


def test_kernel_against_all_subsequences():
    """Landmark kernel, coordinates and collapsed weights against sums over subsequences of four letters, one by one."""

    def all_fours(unit):
        u, out = f"^{unit}$", {}
        for at in itertools.combinations(range(len(u)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                key = "".join(u[a] for a in at)
                out.setdefault(key, []).append(toxicity.DECAY ** (at[3] - at[0] + 1))
        length = sum(w * w for ws in out.values() for w in ws) ** 0.5
        return {k: sum(ws) / length for k, ws in out.items()}

    marks, units = ["idiot", "worthless", "the"], ["idxiot", "idiot", "worth", "and", "thesis"]
    m = toxicity.Landmarks(marks)
    want = [[sum(v * all_fours(b).get(k, 0) for k, v in all_fours(a).items()) for b in marks] for a in units]
    assert np.allclose(m.kernel(units), want, atol=1e-3)
    w = np.array([0.5, 1.0, -2.0])
    svm = toxicity.SubsequenceSvm(m.collapsed(w), 0.25)
    want = m.coordinates(units) @ w + 0.25
    assert want.max() > 0.3 and np.allclose(svm.margins(units), np.maximum(want, 0.25), atol=1e-3)  # nothing scores below the bare bias


def test_drop_toxic_keeps_columns_of_any_name(spark, svm, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *a: svm)
    monkeypatch.setattr(toxicity, "table", lambda *a: None)
    df = spark.createDataFrame([(1, "the idiot", "mine", 0.5, 1), (2, "ter lo", "mine", 0.5, 2), (2, None, None, None, None), (None, "ter", "x", 1.0, 3)], "doc_id long, text string, toxic string, toxic_score double, c0 int")
    got = toxicity.drop_toxic(spark, df, "")
    assert got.schema.names == df.schema.names and sorted(map(str, got.collect())) == sorted(map(str, df.where("doc_id IS NULL OR doc_id = 2").collect()))


def test_ordinal_regression_orders_grades():
    rng = random.Random(2)
    rows, texts = [], []
    known = quality.ChunkTable(lambda new: map(quality.slots, new))
    for _ in range(300):
        g = rng.randrange(3)
        words = [rng.choice(["good", "fine"]) if rng.random() < (0.1, 0.5, 0.9)[g] else rng.choice(["junk%%", "spam!!"]) for _ in range(40)]
        texts.append((g, " ".join(words)))
        rows.append((g, *quality.features(texts[-1][1], known)))
    m = quality.fit_ordinal(rows, 3)
    assert m.cuts[0] < m.cuts[1]
    s = np.array([float(np.dot(m.weights[i], v)) for _, i, v in rows])
    t = m.tails(s)
    assert (t[:, 0] >= t[:, 1]).all()
    assert np.mean((t > 0.5).sum(1) == np.array([g for g, *_ in rows])) > 0.85


def test_quality_rows(spark):
    m = quality.fit_ordinal([], 3)
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "", "x")], "doc_id long, text string, tails string")
    rows = quality.grade(df, m).collect()
    assert len(rows) == 4 and all(len(r.tails) == 2 for r in rows)
    assert quality.grade(df.limit(0), m).count() == 0


def brute_rule(host, path):
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return best


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://M.Example.COM/en/7x?q#f", "http://example.com/en/8", "https://xexample.com/en/7", "http://a.example.net/de/8?x", "http://example.net/de/9", "http://b.org/es/1", "http://org/es/", "http://c.com?x=/en/", "http://É.com/en/é", "http://casino-win.example.com/fr/1"]
    urls += [r[0] for r in duckdb.sql("SELECT url FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judge_urls(df).collect():
        host, path = url_filter.split_url(urls[r.page_id])
        want = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want.text if want else None)
        if want:
            assert r.verdict == want.verdict
        else:
            assert r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert url_filter.split_url("HTTP://M.Example.COM/en/7x?q#f") == ("m.example.com", "/en/7x")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_trees_tell_held_out_hosts(spark):
    """Fitted on the URLs that rules block and others, measured on hosts that were held out."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = url_filter.labelled_urls(pages, url_filter.RULES)
    assert 0 < len(labelled) <= url_filter.MOST_LABELLED and not {zlib.crc32(url_filter.split_url(u)[0].encode()) % 4 for u, _ in labelled} & {2}
    model = url_filter.UrlModel(labelled)
    test = url_filter.labels_by_rule(pages, url_filter.RULES).where(url_filter.held_out_host(F.col("host"))).collect()
    s, y = model.score([(r.url, *url_filter.split_url(r.url)) for r in test]), np.array([r.y for r in test])
    print("urls held out", len(y), "block", y.mean(), "right", np.mean((s >= 0.5) == y), "precision", y[s >= 0.5].mean(), "recall", (s >= 0.5)[y == 1].mean(), "scores", len(set(s.round(6))))
    assert y[s >= 0.5].mean() > 0.8 and (s >= 0.5)[y == 1].mean() > 0.8


def sql_rows(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    con.sql("CREATE VIEW benchmark AS SELECT * FROM '/root/testdata/sf0.001/benchmark.parquet'")
    r = con.sql(sql)
    return [dict(zip(r.columns, row, strict=True)) for row in r.fetchall()]


def without_runs(texts, run=50):
    """The texts without their runs of 50 words that stand elsewhere, but for the first of each, run by run."""
    words = {d: substring.words_of(t or "") for d, t in texts.items()}
    where = {}
    for d in sorted(words):
        for k in range(len(words[d]) - run + 1):
            where.setdefault(tuple(words[d][k : k + run]), []).append((d, k))
    gone, stay = {}, {}
    for places in where.values():
        if len(places) > 1:
            for n, (d, k) in enumerate(places):
                (gone if n else stay).setdefault(d, set()).update(range(k, k + run))
    out = dict(texts)
    for d, own in gone.items():
        left = sorted(own - stay.get(d, set()))
        starts = [w for w in left if w - 1 not in own or w - 1 in stay.get(d, set())]
        ends = [w for w in left if w + 1 not in own or w + 1 in stay.get(d, set())]
        out[d] = substring.without_words(texts[d], [(a, b - a + 1) for a, b in zip(starts, ends, strict=True)])
    return out


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows against a brute-force version of it on the same input."""
    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf, "documents")
    svm = toxicity.train(docs, corpus_pipeline.table(spark, sf, "labels"))
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf), name)
        assert after.columns == columns
        was = before.toPandas()
        texts = dict(zip(was.doc_id, was.text, strict=True))
        if name == "toxicity":
            want = {d: t for d, t in texts.items() if top(svm, t or "") < 0.3}
        elif name == "ngram_join":
            want = {r["doc_id"]: texts[r["doc_id"]] for r in sql_rows(setjoin.OP9_SQL, was) if r["doc_id"] == r["component_id"]}
        elif name == "decontamination":
            bad = {r["doc_id"] for r in sql_rows(decontaminate.OP5_SQL, was)}
            want = {d: t for d, t in texts.items() if d not in bad}
        else:
            first = without_runs(texts)
            left = pd.DataFrame({"doc_id": list(first), "text": list(first.values())})
            spans = {}
            for r in sql_rows(substring.OP8_SQL.replace("size >= 30", "size >= 5"), left):
                if not r["kept"]:
                    spans.setdefault(r["doc_id"], []).append((r["word"], r["words"], r["passage_words"]))
            want = {d: substring.without_paragraphs(t, spans[d]) if d in spans else t for d, t in first.items()}
            want = {d: t for d, t in want.items() if t == texts[d] or t.strip(" \t\r\n")}
        now = after.toPandas()
        assert dict(zip(now.doc_id, now.text, strict=True)) == want and len(now) == len(want)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    found = {}
    for r in pieces:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == lengths
