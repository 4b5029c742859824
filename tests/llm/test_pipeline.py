"""The corpus pipeline against the same stages written out plainly."""

import random
from collections import Counter

import corpus_pipeline
from test_text_operators import SCHEMA, components, fill, prose, shingles

from shelfwise.llm import mixing


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = random.Random(11)
    base = [prose(rng, rng.randint(5, 90)) for _ in range(30)]
    items = [prose(rng, 30), prose(rng, 16)]
    texts = [*base, *base[:4], base[5] + " end", f"{prose(rng, 60)} {items[0]}", f"{items[1]} {prose(rng, 30)}", f"{prose(rng, 10)} password = abcdef123456 {prose(rng, 10)}", None, "", "123 456"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    groups = components({i: shingles(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    marks = [shingles(t) for t in items]
    kept = {i: t for i, t in kept.items() if not any(len(shingles(t) & q) >= 0.75 * len(q) for q in marks)}
    kept = {i: t.replace("abcdef123456", "[SECRET]") for i, t in kept.items()}
    sizes = Counter()
    for i, t in kept.items():
        sizes[f"s{i % 4}"] += len(t.split())
    targets = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 3)

    steps, stage_docs = [], docs
    for name, step in corpus_pipeline.STAGES[:4]:
        stage_docs = step(spark, stage_docs, str(tmp_path))
        assert stage_docs.columns == docs.columns, name
        steps.append(name)
    assert {r.doc_id: r.text for r in stage_docs.collect()} == kept
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in out}.items() <= kept.items() and all(1 <= r.copies <= 3 for r in out)
    for s, want in targets.items():
        assert abs(sum(r.copies * len(r.text.split()) for r in out if r.source == s) - want) <= 90
    counts = {r.doc_id: r.copies for r in mixing.mix_sources(stage_docs).collect()}
    assert {r.doc_id: r.copies for r in out} == {i: n for i, n in counts.items() if n}


def test_language_stage_acts_on_the_prediction(spark):
    rng = random.Random(3)
    tongues = {"en": "the and with that from this", "de": "der und mit dass von nicht", "fr": "le et avec que des pas"}
    say = lambda lang, n: " ".join(rng.choices(tongues[lang].split(), k=n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(list(tongues) * 40)]
    rows += [(1000, say("de", 40), "en"), (1001, say("fr", 40), None), (1002, "12 34 !!", "en"), (1003, None, "de"), (1004, "", "fr")]
    docs = spark.createDataFrame([(*r, "web", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _predicted0 int")
    out = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert out.columns == docs.columns
    lang = {r.doc_id: r.lang for r in out.collect()}
    assert lang[1000] == "de" and lang[1001] == "fr" and not {1002, 1003, 1004} & set(lang)
    assert all(lang.get(i, x) == x for i, _, x in rows[:120]) and len(lang) >= 110


def test_stages_with_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30), "en", "s", 1, 7, 8, 9, 10) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tag int, row int, copies int, hash int")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} <= {0, 1, 2, 3, 4} and {"tag", "row", "copies", "hash"} <= set(docs.columns)


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
