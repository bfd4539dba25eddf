"""Cases that the docstrings define, for every operator and stage: empty tables, null and repeated ids, nulls in any
column, empty and very long texts, ties, repeated rows, extra columns with clashing names; and workers without the package."""

import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexforge.llm import exact_dedup, html_extract, jaccard_join, language_id, lm_scoring, mixing, packing, quality_model, quality_rules, sentencepiece_np, toxicity

from fixtures import components_by_force, corpus, low, words
from test_operators import MODEL, RANKS, plain_counts, plain_targets

LONG = "word and more of the same text, " * 40_000
#: Names that operators use on the way, besides the columns of documents.
CLASH = "_dropped _copies _row _m _w _l _f _words _lines quality key part bucket shingles a b n score row sig u h bin src size place label id component_id digest keep_id page_id".split()

MODEL_HTML = html_extract.train()


def tox(docs):
    labels = docs.filter("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.train(docs, labels))


def rated(docs):
    return quality_model.classify(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))


#: Each gives one row for each row of documents.
ROWS = {
    "toxicity": tox,
    "quality_model": rated,
    "jaccard": jaccard_join.near_duplicates,
    "mix": mixing.mix,
    "lm": lambda docs: lm_scoring.score(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))),
    "quality": quality_rules.annotate,
    "dedup": lambda docs: exact_dedup.dedup(docs, exact_dedup.DigestIndex(docs.sparkSession, buckets=2)),
    "language": lambda docs: language_id.predict(docs, language_id.train(docs, steps=5)),
    "sentencepiece": lambda docs: sentencepiece_np.encode(docs, MODEL),
    "html": lambda docs: html_extract.main_text(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "source"), MODEL_HTML),
}


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, nulls in every column, repeated rows, blank and very long texts, clashing columns."""
    text = " ".join("w%d" % i for i in range(60)) + " the of and"
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text.upper(), "fr", None), (2, "other words, few", None, "s"), (None, text, None, None), (None, None, None, None), (None, None, "en", "t")]
    rows += [(3, "", "en", "t"), (4, " \n\t", "en", "t"), (5, LONG, "en", "s"), (6, "x" * 200_000, "fr", "t"), (7, "İ <b " * 50, "en", "t"), (8, "zwölf Boxkämpfer 中文 😀", "de", "s"), (1 << 60, text + " tail", "en", "s")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(7).alias(c) for c in CLASH))


@pytest.mark.parametrize("name", ROWS)
def test_every_row_of_an_odd_table_comes_back(odd, name):
    got = ROWS[name](odd).collect()
    key = "page_id" if name == "html" else "doc_id"
    assert Counter(r[key] for r in got) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", ROWS)
def test_empty_tables(odd, name):
    assert ROWS[name](odd.limit(0)).count() == 0


def test_more_empty_tables(spark, odd):
    none = odd.limit(0)
    packed = packing.pack_documents(none, RANKS)
    assert packed.count() == 0 and packing.unpack(packed).count() == 0
    assert sentencepiece_np.decode(sentencepiece_np.encode(none, MODEL), MODEL).count() == 0
    assert mixing.mixed(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_equal_texts_get_equal_results(odd):
    text = odd.filter("doc_id = 1").first()["text"]
    for name in ("toxicity", "lm", "language", "sentencepiece"):
        rows = ROWS[name](odd.filter(F.col("text") == text).unionByName(odd.filter("doc_id > 2"))).filter("doc_id IS NULL OR doc_id = 1").collect()
        near = [tuple(round(x, 4) if isinstance(x, float) else repr(x) for x in r[1:]) for r in rows]
        assert len(rows) == 3 and len(set(near)) == 1


def test_odd_ids_are_joined_as_rows(odd):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd).collect()), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == sorted(components_by_force(rows), key=repr)


def test_rows_of_one_id_have_their_own_copies(odd):
    docs = odd.filter("coalesce(length(text), 0) < 100000").select("doc_id", "text", "source", "_copies", "_row")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    taken = Counter()
    for r in out.collect():
        taken[r["source"]] += len(words(r["text"]))
    want = plain_targets(sizes)
    assert all(want[s] - 64 <= taken[s] <= want[s] for s in want)


def test_a_null_id_stays_only_without_another(odd):
    got = exact_dedup.dedup(odd, exact_dedup.DigestIndex(odd.sparkSession, buckets=2)).collect()
    assert sum(r["kept"] for r in got if r["doc_id"] is None) == 0  # a named copy or blank row is there
    alone = exact_dedup.dedup(odd.filter("doc_id IS NULL"), exact_dedup.DigestIndex(odd.sparkSession, buckets=2)).collect()
    assert all(r["kept"] and r["keep_id"] is None for r in alone)


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("stage", list(STAGES)[:-1])
def test_stages_keep_columns(spark, odd, stage):
    assert STAGES[stage](spark, odd, "").columns == odd.columns
    assert STAGES[stage](spark, odd.limit(0), "").count() == 0


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import sentencepiece

    rows = [r[:5] for r in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    good = [r for r in rows if plain_counts(r[1])["kept"]]
    last = {}
    for r in good:
        last[low(r[1])] = max(r[0], last.get(low(r[1]), -1))
    distinct = [r for r in good if last[low(r[1])] == r[0]]
    near = [r for r, (_, _, c) in zip(distinct, components_by_force([(r[0], r[1]) for r in distinct]), strict=True) if r[0] == c]
    assert 10 < len(near) < len(distinct) < len(good) < len(rows)
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    got = out.collect()
    times, of = Counter(r["doc_id"] for r in got), {r[0]: r for r in near}
    assert set(times) <= set(of) and max(times.values()) <= 2
    sizes, taken = Counter(), Counter()
    for r in near:
        sizes[r[3]] += len(words(r[1]))
        taken[r[3]] += len(words(r[1])) * times[r[0]]
    want = plain_targets(sizes)
    for s in want:  # whole repeats, and the best subset for what is left
        whole, sums = int(want[s] // sizes[s]), {0}
        for r in near:
            if r[3] == s:
                sums |= {x + len(words(r[1])) for x in sums}
        assert taken[s] == whole * sizes[s] + max(x for x in sums if x <= want[s] - whole * sizes[s])
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(r["ids"] == sp.encode(of[r["doc_id"]][1]) and r["n_tokens"] == len(r["ids"]) for r in got)


def test_workers_need_no_package(tmp_path):
    """Every query on executors whose path lacks the repository."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", {str(tmp_path / "wh")!r}).config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
import __spark_entry__ as e
for name, q in e.queries().items():
    if name == "pipeline" or name[:2] == "op" and name[2].isdigit():
        print(name, q(s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines())
    assert len(counts) == 14 and all(int(n) > 0 for n in counts.values())
