"""Tables in folders of files, and steps that must stay cheap on large tables."""

import pytest

from rolecast.plans.registry import QUERIES
from rolecast.plans import load_queries

DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("layout", ["folder", "file"])
def test_documents_stream_from_a_folder_and_from_a_file(spark, tmp_path, layout):
    load_queries()
    rows = [(1, "web", "en", 60, "one line\nanother"), (2, "web", "de", 10, ""), (3, "book", None, 99, "x\n" * 40), (3, "book", "en", 51, " ")]
    folder = tmp_path / "documents.parquet"
    made = folder if layout == "folder" else tmp_path / "made"
    spark.createDataFrame(rows, DOCUMENT).repartition(1 if layout == "file" else 3).write.parquet(str(made))
    spark.createDataFrame([(9,)], "other long").write.parquet(str(tmp_path / "labels.parquet"))
    if layout == "file":
        folder.write_bytes(next(made.glob("part-*.parquet")).read_bytes())
    found = QUERIES["screen_stream"](spark, str(tmp_path)).collect()
    # profiles, more than 20 skills at a high level, experts without months, endorsed above 50, first line blank
    assert [tuple(r) for r in found] == [(4, 1, 4, 3, 2)]


def test_lines_are_made_once_and_blank_ones_vanish(spark):
    from pyspark.sql import functions as F

    from rolecast.sources.profiles import parse_profiles

    made = spark.range(6).select(F.when(F.col("id") == 2, F.lit("  ")).when(F.col("id") == 3, F.lit(None)).when(F.col("id") == 4, F.lit("{")).otherwise(
        F.to_json(F.struct(F.concat(F.lit("C"), F.col("id").cast("string")).alias("candidate_id")))).alias("value"))
    parsed = parse_profiles(made)
    assert sorted((r.candidate_id or "", r._corrupt_record or "") for r in parsed.collect()) == [("", "{"), ("C0", ""), ("C1", ""), ("C5", "")]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") == 1


def test_rules_are_compiled_apart_from_the_removal_of_empty_results(spark, tmp_path):
    from rolecast.operators.screen import add_flags
    from samples import HONEYPOT, PLANTED, VALID, load

    flagged = add_flags(load(spark, tmp_path, VALID, HONEYPOT, PLANTED))
    lines = flagged._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in lines if "AS _results" in x and "AS flags" in x] and any("AS _results" in x for x in lines)
    assert sorted(len(r.flags) > 0 for r in flagged.collect()) == [False, True, True]


def test_rejected_lines_need_no_fields(spark, tmp_path):
    from rolecast.sources.profiles import read_rejected

    (tmp_path / "in.jsonl").write_text('{"candidate_id": 1}\n\n{"candidate_id": "x"} {}\n[1]\n7\n{}\n{"a": NaN}\n   \n{"skills": 3, "skills": [null]}\nnull\n{"a"')
    rejected = read_rejected(spark, str(tmp_path / "in.jsonl"))
    assert sorted(r.line for r in rejected.collect()) == sorted(['{"candidate_id": "x"} {}', "[1]", "7", "null", '{"a"'])
    assert "career_history" not in rejected._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_not_joined_to_their_keys_again(spark):
    from rolecast.operators import tfidf as TI

    rows = [("a", "x y"), ("a", "y"), (None, "x"), (None, None), ("b", ""), ("c", "unknown"), ("c", "unknown")]
    texts = spark.createDataFrame(rows, "candidate_id string, text string")
    encoded = TI.encode_tfidf(texts, TI.fit_tfidf(texts.where("text <> 'unknown' OR text IS NULL")))
    found = {r.candidate_id: [x.term for x in r.vector] for r in encoded.collect()}
    assert found == {"a": ["x", "y"], None: ["x"], "b": [], "c": []} and encoded.count() == 4
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
