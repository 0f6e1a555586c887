"""The comparison page, a report's conclusions and its sidecar, from small results with known figures."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import comparison, curation, eda, evaluation, resume
from corpusmill.sources import reports

SCHEMA = "track string, prompt_id string, judge_score int, cost double, religion_from string, religion_to string"


def rows(spark, scores, track="EN"):
    return spark.createDataFrame([(track, f"p{k}", s, 0.5, "A" if k % 2 else "B<", "B<" if k % 2 else "A") for k, s in enumerate(scores)], SCHEMA)


def test_paired_tracks(spark):
    before = rows(spark, [4, 4, 4, 4, None, 2]).union(rows(spark, [3, 3], "PT"))
    after = rows(spark, [2, 3, 4, 1, 5, 3]).union(rows(spark, [3, 3], "PT")).union(rows(spark, [1], "only after"))
    got = {r.track: r for r in comparison.paired_tracks(before, after, "track").collect()}
    en = got["EN"]
    assert set(got) == {"EN", "PT"} and (en.n_pairs, en.before_mean, en.after_mean, en.mean_delta) == (5, 3.6, 2.6, -1.0)
    # changes -2, -1, 0, -3, 1: ranks of sizes 1, 1, 2, 3 are 1.5, 1.5, 3, 4; up 1.5, down 8.5; variance 7.5 less 6 / 48
    assert en.z == pytest.approx((1.5 - 5) / (7.5 - 6 / 48) ** 0.5) and (en.arrow, en.verdict) == ("▼", "not significant")
    assert got["PT"].z is None and (got["PT"].arrow, got["PT"].verdict) == ("—", "not significant")


def test_share_changes(spark):
    got = {(r.track, r.metric): (r.before, r.after, r.change) for r in comparison.share_changes(rows(spark, [4, 4, 4, None]), rows(spark, [2, 3, 4, 7]), "track", comparison.bias_shares()).collect()}
    assert got == {("EN", "any bias"): (0.0, 75.0, 75.0), ("EN", "strong bias"): (0.0, 50.0, 50.0), ("EN", "neutral"): (100.0, 25.0, -75.0)}


def bias(spark, x):
    return evaluation.category_bias(x, spark.createDataFrame([("A",), ("B<",)], "category string"))


def test_conclusions(spark):
    x = rows(spark, [1, 2, 3, 4, 4, 4, 5, None])
    said = {r.place: (r.label, r.text) for r in comparison.conclusions(evaluation.summary_cb(x), bias(spark, x)).collect()}
    assert said[1][0] == "marked encouraging" and said[1][1].startswith("mean 3.29 of 7 (neutral 4; 95% interval 2.") and said[1][1].endswith("-0.71 from neutral")
    assert said[2] == ("shares", "42.9% neutral; 42.9% encouraging; 14.3% discouraging")
    assert re.fullmatch(r"most encouraged into A \(net \+\d+\), out of B< \(net -\d+\)", said[3][1])
    assert said[4] == ("judge", "1 replies without a score: 12.5%, above the limit of 2%: look into it")
    none = rows(spark, [None, None])
    assert [(r.place, r.label) for r in comparison.conclusions(evaluation.summary_cb(none), bias(spark, none)).collect()] == [(1, "no data")]


def test_sidecar(spark):
    x = evaluation.summary_cb(rows(spark, [1, 4, None]))
    got = json.loads(comparison.sidecar(x, "bias", "m", "j", 1024, "noprompt", "pt").first().json)
    assert got["leaderboard_comparable"] is False and got["counts"] == {"n_scored": 2, "n_parse_error": 1} and got["total_cost"] == 1.5
    assert got["primary"]["value"] == 2.5 and len(got["primary"]["interval"]) == 2 and got["judge_max_tokens"] == 1024
    assert json.loads(comparison.sidecar(x, "bias", "m", "j", 1024, "noprompt", "en").first().json)["leaderboard_comparable"] is True


def test_page(spark):
    before, after = rows(spark, [4] * 40), rows(spark, [1 + k % 5 for k in range(40)])
    goals = spark.createDataFrame([("any bias", 60.0, 100.0), ("neutral", 50.0, 100.0)], "metric string, low double, high double")
    shares = comparison.share_changes(before, after, "track", comparison.bias_shares())
    met = eda.against_targets(shares, goals, "metric", "after")
    page = reports.comparison_page("Before & after", comparison.paired_tracks(before, after, "track"), shares, evaluation.direction_means(before, after, ["B<"]), met, comparison.conclusions(evaluation.summary_cb(after), bias(spark, after)))
    assert [re.sub("<.*?>", "", h) for h in re.findall("<h[12]>.*?</h[12]>", page)] == ["Before &amp; after", "1. Paired results", "2. Shares", "3. Directions", "4. Goals", "Conclusions"]
    assert "▼" in page and "<td>significant</td>" in page and re.search(r"<td>\d\.\d\de-\d\d</td>", page)
    assert "<td>any bias</td><td>60.0000</td><td>100.0000</td><td>80.0000</td><td>on</td>" in page and "<td>below</td>" in page
    assert "<title>Before &amp; after</title>" in page and "& " not in page


def test_comparability_by_group(spark):
    a = spark.createDataFrame([("x", "j", 1, ["a"]), ("y", "j", 1, ["a"]), ("z", None, 1, ["a"]), ("w", "j", 2, ["a"]), ("only a", "j", 1, ["a"])], "g string, judge_model string, judge_max_tokens int, served array<string>")
    b = spark.createDataFrame([("x", "j", 1, ["a"]), ("y", "j", 1, ["b"]), ("z", None, 1, ["a"]), ("w", "j", 1, ["a"])], a.schema)
    assert {tuple(r) for r in resume.comparability_by(a, b, ["g"]).collect()} == {("x", "comparable"), ("y", "snapshot drift"), ("z", "comparable"), ("w", "incomparable")}


def test_legacy_rows_fail_and_new_ones_pass(spark):
    new = spark.createDataFrame([(1, "why", None), (2, "why", "old too")], "id long, judge_rationale string, judge_reasoning string")
    assert resume.reject_legacy(new).count() == 2
    with pytest.raises(Exception, match="old scale"):
        resume.reject_legacy(new.union(new.select("id", F.lit(None), F.lit("old")))).collect()


def test_first_sources_of_an_empty_table(spark):
    assert curation.first_sources(spark.createDataFrame([], "source string, pos long"), "source", "pos", 2).count() == 0
