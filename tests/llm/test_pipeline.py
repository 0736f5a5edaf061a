"""The pipeline against a plain version of each stage, and every query of the subpackage over small tables."""

import random

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from icekeel.llm import bpe, decontamination, jaccard_join, quality, secret_scan
from icekeel.llm import queries as registered

WORDS = [f"w{chr(97 + k % 26)}{k}" for k in range(500)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, at = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    items = [" ".join(r.choices(WORDS, k=20)) for _ in range(5)]
    texts = []
    for k in range(160):
        w = r.choices(WORDS, k=r.randint(30, 90))
        kind = k % 8
        if kind == 0:
            texts.append(" ".join(x.upper() + "!!" for x in w))
        elif kind == 1 and len(texts) > 3:
            v = texts[-1].split()
            v[len(v) // 2] = "edited"
            texts.append(" ".join(v))
        elif kind == 2:
            texts.append(" ".join([*w[:9], items[k % 5], *w[9:]]))
        elif kind == 3:
            texts.append(" ".join([*w[:9], f'token = "{r.getrandbits(160):040x}"', *w[9:]]))
        elif kind == 4:
            texts.append(texts[-1])
        else:
            texts.append(" ".join(w))
    texts[5], texts[6] = None, ""
    docs = [(i, t, "en", "src0", len(t) if t is not None else None, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 8 == 0 else 1, 0) for i in range(160) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://h/{i}", f"<article><p>page {i}</p></article>") for i in range(20)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def plain_near_duplicates(rows, k=5, share=0.8):
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    group = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if i != j and a and b and len(a & b) >= share * len(a | b) and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return {i for i in rows if group[i] == i}


def test_pipeline_does_what_its_stages_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in quality.scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if scored[r.doc_id]}
    stayed = plain_near_duplicates(rows)
    items = [decontamination.hash_words(decontamination.words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        doc = decontamination.hash_words(decontamination.words_of(text or ""))
        return any(decontamination.overlap(doc, item, s) for item in items for s in range(-len(item) + 1, len(doc)))

    want = {}
    for i in sorted(stayed):
        if not leaks(rows[i]):
            text = rows[i] and secret_scan.redacted(rows[i])
            want[i] = (bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, text or "")
    got = {r.doc_id: (r.ids, r.text) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
    assert 0 < len(got) < len(rows) < 160 and any("[SECRET]" in t for _, t in got.values())


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]


def test_stages_start_on_a_collected_heap(spark, sf_dir, monkeypatch):
    def full_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = []
    for module, function in ((quality, "keep_good"), (jaccard_join, "keep_one"), (decontamination, "keep_clean"), (secret_scan, "redact"), (bpe, "encode")):
        monkeypatch.setattr(module, function, lambda *a, **b: begun.append(full_collections()))
    for name, stage in corpus_pipeline.STAGES:
        before = full_collections()
        stage(spark, docs, sf_dir)
        assert begun.pop() > before, name


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_queries_return_a_row_for_each_row(spark, sf_dir, name):
    rows = registered.queries()[name](spark, sf_dir).collect()
    if name == "op9_decontamination":
        assert {r.doc_id for r in rows} >= {i for i in range(160) if i % 8 == 2}
    elif name != "pipeline":
        assert len(rows) == (20 if name == "op8_html_text" else 160)


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline"} < names and {int(n[2:].split("_")[0]) for n in registered.queries() if n.startswith("op")} == set(range(1, 11))


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, q in registered.queries().items():
        assert q(spark, str(tmp_path)).collect() == [], name
