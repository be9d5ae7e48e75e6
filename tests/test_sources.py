import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hearken.functions.fixed_values import (
    FEATURE_HEADERS,
    HOLDOUT_SCALES,
    PAINPOINT_HEADERS,
    STRENGTH_HEADERS,
    VERBATIM_HEADERS,
)
from hearken.operators import scoring, survey
from hearken.sources import readers, sinks


def put(path, text, bom=False):
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    return str(path)


def test_reviews_with_byte_order_mark_and_line_breaks(spark, tmp_path):
    text = 'review,rating,date,likes,source_type\n"첫 줄\n둘째 ""줄""",1,2024-01-02,3,google_play\n,5,2024-01-03,,google_play\n'
    got = rows(readers.reviews_csv(spark, put(tmp_path / "r.csv", text, bom=True)), "review", "rating", "likes")
    assert got == [("첫 줄\n둘째 \"줄\"", 1, 3), (None, 5, None)]


def test_survey_export_is_coded_and_exported(spark, tmp_path):
    heads = ["1. 가전", "2. 앱", "3. 나이", "4. 가구", "5. 주거", "6. 이사", "7. 계기", "8. a", "9. b", "10. c", "11-1. w", "11-2. n", "12. o", "13. p"]
    cells = ["1대", "거의 매일", "30대", "자녀 있음", "전세", "있다", "혼수", "4 자주", "5", "x", '"가민, 없음"', "2", "3", "유료라도 쓸 의향이 있다"]
    out = ["0대 (없음)"] + [""] * 13
    path = put(tmp_path / "s.csv", "\n".join(",".join(r) for r in (heads, cells, out)) + "\n", bom=True)
    named = survey.with_question_names(readers.survey_export(spark, path))
    coded = survey.encode(survey.without_screened_out(named), keep=())
    row = coded.first().asDict()
    assert [row[f] for f in FEATURE_HEADERS] == [1.0, 4.0, 2.0, 1.0, 1.0, 1.0, 1.0, 4.0, 5.0, None, 1.0, 2.0, 3.0, 2.0]
    assert coded.count() == 1 and row["tenure_text"] == "전세" and "worry_text" not in row
    headers = {**FEATURE_HEADERS, "tenure_text": VERBATIM_HEADERS["tenure_text"]}
    sinks.report_csv(coded, str(tmp_path / "out"), headers)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(headers.values())


def test_contracts_of_report_files(spark, tmp_path):
    good = ",".join(PAINPOINT_HEADERS.values())
    assert rows(readers.painpoints_csv(spark, put(tmp_path / "a.csv", good + "\nT0,3,2.0,50.0,50.0,말\n")), "topic_label", "freq") == [("T0", "3")]
    for name, text in {"empty.csv": good + "\n", "old.csv": "PainPoint(토픽),빈도\nT0,3\n"}.items():
        with pytest.raises(ValueError):
            readers.painpoints_csv(spark, put(tmp_path / name, text))
    scores = readers.cx_scores(spark, put(tmp_path / "cx.csv", "이름,a,b,c,d,e\n자사,3,4,3,6,x\n"))
    assert rows(scores.filter("not valid"), "axis") == [("d",), ("e",)]
    with pytest.raises(ValueError):
        readers.cx_scores(spark, put(tmp_path / "cx2.csv", "이름,a\n자사,3\n"))
    strengths = spark.createDataFrame([("좋아요", 5, 2)], "review string, rating int, likes int")
    sinks.report_csv(strengths, str(tmp_path / "st"), STRENGTH_HEADERS)
    assert spark.read.option("header", True).csv(str(tmp_path / "st")).first()["평점"] == "5"


def test_metas_and_manifests(spark, tmp_path):
    put(tmp_path / "ok.json", json.dumps({"run_id": "r1", "status": "ok", "negative_count": 3}, indent=2))
    put(tmp_path / "bad.json", "{not json")
    metas = {r["file"].rsplit("/", 1)[1]: r for r in readers.lineage_metas(spark, str(tmp_path) + "/*.json").collect()}
    assert metas["ok.json"]["negative_count"] == 3 and metas["ok.json"]["_corrupt_record"] is None
    assert metas["bad.json"]["_corrupt_record"] is not None
    runs = tmp_path / "runs"
    for run, status in [("20260101", "passed"), ("20260301", "failed"), ("20260201", "passed")]:
        (runs / run).mkdir(parents=True)
        put(runs / run / "m.json", json.dumps({"run_id": run, "gate_status": status, "agents": {"A": "success"}}))
    found = readers.newest_passed(readers.run_manifests(spark, str(runs) + "/*/m.json")).first()
    assert found["run_id"] == "20260201" and found["agents"] == {"A": "success"}
    none = readers.run_manifests(spark, str(runs) + "/20260301/m.json")
    assert readers.newest_passed(none).count() == 0


def test_landed_pages(spark, tmp_path):
    page = {"axis": "A", "query": "q", "origin": "blog", "items": [{"title": "<b>이사</b>", "description": "설치 <i>후기</i>", "link": "u"}, {"title": "x", "link": "v"}]}
    hits = readers.search_pages(spark, put(tmp_path / "p.json", json.dumps(page, ensure_ascii=False)))
    assert rows(hits, "link", "review") == [("u", "이사 설치 후기"), ("v", "x ")]
    batch = [{"content": f"r{i % 3}", "score": 1, "at": f"2024-01-0{1 + i % 3}T00:00:00", "thumbsUpCount": i} for i in range(6)]
    path = put(tmp_path / "b.json", "\n".join(json.dumps(b) for b in batch))
    assert rows(readers.review_pages(spark, path), "review", "likes") == [("r0", 3), ("r1", 4), ("r2", 5)]
    assert readers.review_pages(spark, path, max_reviews=2).count() == 1


def test_answers_with_embedded_json(spark):
    texts = [
        'sure: {"distribution": {"0": 1, "1": "3"}} ok', '{"2": 4}', "no json", '{"0": -1, "1": 2}', '{"0": 0}', '{"0": "x", "1": 1}', '{"0": 1',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["distribution"] for r in scoring.parsed_answers(df, "t", HOLDOUT_SCALES["pay_intent"]).orderBy("i").collect()]
    assert got == [{"0": 0.25, "1": 0.75, "2": 0.0}, {"0": 0.0, "1": 0.0, "2": 1.0}] + [None] * 5


def test_publish_replaces_one_run(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    sinks.publish(df, path, "a")
    sinks.publish(df, path, "b")
    sinks.publish(df.filter(F.col("x") == 1), path, "a")
    assert rows(spark.read.parquet(path), "run_id", "x") == [("a", 1), ("b", 1), ("b", 2)]
