"""Operators on small literal inputs."""

import hashlib
import hmac
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import contracts
from tidemark.functions import dates, hashing, maths, text
from tidemark.operators import audits, classify, learning, metrics, monthly, sampling, targets, windows
from tidemark.sources import files, jsonl


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean_text(spark):
    r = one(spark, "  <b>Ａ smart&nbsp; plug</b>\n works  ", text.clean_text)
    assert (r.text, r.html, r.unicode, r.whitespace) == ("A smart plug works", True, True, True)
    assert one(spark, None, text.clean_text).text == ""
    assert one(spark, "  NOT   Working  ", text.normalize_for_dedup) == "not working"
    assert one(spark, "  <b>A smart&nbsp; plug</b>\n works  ", text.clean_text_simple) == "A smart plug works"


def test_epoch(spark):
    got = [one(spark, x, dates.epoch_millis) for x in ("1700000000123", None, "true", "-1", "1.5", "")]
    assert got == [1700000000123, None, None, None, None, None]
    d = spark.createDataFrame([(1700000000123,), (-1,), (None,)], "ms long")
    ts, month = dates.timestamp_fields(F.col("ms"))
    assert [r.m for r in d.select(month.alias("m")).collect()] == [date(2023, 11, 1), None, None]
    assert d.select(F.unix_millis(ts).alias("x")).first().x == 1700000000123


def test_hmac(spark):
    salt = bytes([0x11] * 32)
    assert one(spark, "RAW-USER-123", lambda c: hashing.hmac_sha256(salt, c)) == hmac.new(salt, b"RAW-USER-123", hashlib.sha256).hexdigest()
    assert one(spark, "", lambda c: hashing.hmac_sha256(salt, c)) is None
    assert one(spark, None, lambda c: hashing.hmac_sha256(b"x" * 100, c)) is None


def test_star_header(spark):
    f = text.strip_star_header
    assert one(spark, "One Star\nStopped working", f) == "Stopped working"
    assert one(spark, "I gave it one star because it stopped working", f).startswith("I gave")
    assert one(spark, "Five Stars\n\nThis plug works", f) == "This plug works"


def test_proximity(spark):
    assert one(spark, "Wi-Fi and Z-Wave", text.normalize_protocol) == "wifi and zwave"
    near = lambda c: text.within_tokens(c, ["smart"], ["bulb"], 6)
    assert one(spark, "smart wifi led color bulb", near) is True
    assert one(spark, "smart vacuum cleaner with a very long cord and one bulb", near) is False


def test_keyword_codes(spark):
    rules = {"F2": ["disconnect"], "F5": ["alexa"], "F7": ["smok", "melted"]}
    f = lambda c: text.keyword_codes(text.normalize_simple(c), rules, ["plug"], ["broke"], ["shipping"])
    assert one(spark, "It keeps disconnecting and Alexa is lost", f) == ["F2", "F5"]
    assert one(spark, "The plug broke", f) == ["F1"]
    assert one(spark, "The plug broke in shipping", f) == []
    assert one(spark, "", f) == []


def test_labels(spark):
    assert one(spark, "f3, F1;;f1", text.normalize_codes) == "F1;F3"
    assert one(spark, "F9", text.normalize_codes) is None
    assert one(spark, " Uncertain ", text.normalize_binary) == "uncertain"
    assert one(spark, "2", text.normalize_binary) is None


def test_index(spark):
    d = spark.createDataFrame([(0.8, 0.6, 0.2, 1.0)], "f double, s double, t double, p double")
    r = d.select(*(c.alias(k) for k, c in maths.composite_index(*map(F.col, "fstp")).items())).first()
    assert [round(x, 6) for x in r] == [0.62, 0.8, 0.56, 0.656, 0.58]


def test_ordinal(spark):
    d = spark.createDataFrame([(0.2, 0.8), (0.9, 0.4)], "a double, b double")
    done = maths.monotone([F.col("a"), F.col("b")])
    assert [r.b for r in d.select(done[1].alias("b")).collect()] == [0.2, 0.4]
    e = spark.createDataFrame([(0.3, 0.1), (0.8, 0.6)], "a double, b double")
    ps = [F.col("a"), F.col("b")]
    assert [round(r.v, 9) for r in e.select(maths.expected_value(ps, 1).alias("v")).collect()] == [1.4, 2.4]
    assert [r.v for r in e.select(maths.hard_class(ps, 1).alias("v")).collect()] == [1, 3]


MONTHS = [(2020 * 12 + m, n, s, k) for m, n, s, k in ((1, 5, 25, 0), (3, 5, 15, 1), (4, 10, 20, 6), (6, 2, 10, 0))]


@pytest.fixture
def months(spark):
    return spark.createDataFrame([("P1", "smart_plug", *r) for r in MONTHS], "product string, device string, m int, n_reviews long, rating_sum long, low_star_count long")


def test_gap_aware_windows(months):
    r = windows.trailing_and_leading(months).where(f"m = {2020 * 12 + 3}").first()
    assert (r.hist_n_reviews, r.hist_mean, r.hist_low_share) == (10, 4.0, 0.1)
    assert [r[f"fut_n_reviews_{h}"] for h in (1, 2, 3)] == [10, 10, 12]
    assert r.fut_mean_1 == 2.0
    dense = windows.dense_windows(windows.dense_grid(months)).where(f"m = {2020 * 12 + 3}").first()
    assert (dense.hist_n_reviews, dense.fut_n_reviews) == (10, 12)


def test_targets(months):
    w = windows.trailing_and_leading(months)
    r = targets.quality_targets(w).where(f"m = {2020 * 12 + 3}").first()
    assert (r.target_rating_drop_1, r.target_low_star_rise_1, r.target_any_1, r.eligible_1, r.eligible_1_ge10) == (1, 1, 1, True, False)
    first = targets.quality_targets(w).where(f"m = {2020 * 12 + 1}").first()
    assert first.target_any_1 is None and first.eligible_1 is False
    assert targets.quality_targets(w.withColumn("device", F.lit("smart_switch"))).where("eligible_1").count() == 0


def test_split_embargo(spark):
    rows = spark.range(60).select((F.col("id") + 2010 * 12 + 1).cast("int").alias("m"), F.lit(True).alias("ok"))
    s = targets.month_split(rows, "ok").groupBy("split").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count("*").alias("n"))
    g = {r.split: r for r in s.collect()}
    assert g["train"].n == 36 and g["train"].b + 3 < g["validation"].a and g["validation"].b + 3 < g["test"].a
    few = targets.month_split(rows.limit(4), "ok")
    assert {r.split for r in few.collect()} == {"not_eligible"}


def test_failure_months(spark):
    d = spark.createDataFrame([("p1", 1, 0, 0.2), ("p1", 1, 1, 0.8), ("p2", 2, 1, 0.9)], "product string, review_month int, prediction int, probability double")
    r = monthly.failure_months(d).where("product = 'p1'").first()
    assert (r.n_reviews, r.failure_share, r.mean_probability) == (2, 0.5, 0.5)


def test_histogram(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    assert [r.n for r in monthly.histogram(d, "x", [0, 0.5, 1]).orderBy("bin").collect()] == [1, 2]


def test_dedup(spark):
    rows = [("k", "Home_and_Kitchen", 1, "short", 2, "p", None), ("k", "Electronics", 2, "longer text", 1, "p", "a"), (None, "Electronics", 1, "x", 3, "q", None)]
    d = spark.createDataFrame(rows, "duplicate_key string, source_domain string, nonempty_fields int, text string, row_number int, parent_asin string, asin string")
    got = audits.dedup_reviews(d.where("duplicate_key IS NOT NULL")).collect()
    assert len(got) == 1 and got[0].source_domain == "Electronics"


def test_metrics(spark):
    d = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.9), (0, 0.9)], "y int, p double")
    assert round(metrics.average_precision(d, "y", "p").first()[0], 9) == 0.5
    assert round(metrics.roc_auc(d, "y", "p").first()[0], 9) == round(2 / 3, 9)
    e = d.unionByName(spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7)], "y int, p double"))
    assert metrics.roc_auc(e.where("y = 1"), "y", "p").first()[0] is None
    b = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "y int, yhat int")
    assert all(v == 0.5 for k, v in metrics.binary_metrics(b, "y", "yhat").first().asDict().items() if k not in ("tn", "fp", "fn", "tp"))
    o = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "a int, b int")
    assert round(metrics.ordinal_metrics(o, "a", "b", (1, 2, 3)).first().mae, 9) == round(1 / 3, 9)
    assert metrics.kappa(b.where("y = 0 AND yhat = 0"), "y", "yhat", (0, 1)).first().kappa is None


def test_apportionment():
    assert sampling.bucket_targets(232, {"high_uncertainty": 0.4, "rating_keyword_disagreement": 0.3}) == {"high_uncertainty": 92, "rating_keyword_disagreement": 69, "diversity_control": 71}
    assert sampling.proportional_targets(10, sampling.TIME_SHARES) == {"early_2011_2017": 3, "middle_2018_2020": 3, "recent_2021_2023": 4}


def test_balanced_selection(spark):
    rows = [(f"k{i}", f"p{i % 4}", i % 2 == 0, list(sampling.RATING_SHARES)[i % 3], list(sampling.TIME_SHARES)[i % 3], "g") for i in range(20)]
    pool = spark.createDataFrame(rows, "duplicate_key string, parent_asin string, keyword_candidate_hit boolean, rating_stratum string, time_stratum string, device string")
    a, b = ([r.duplicate_key for r in sampling.balanced_select(p, 10, 20260731, "t", "device").orderBy("place").collect()] for p in (pool, pool.orderBy(F.desc("duplicate_key"))))
    assert a == b and len(set(a)) == 10 and {int(k[1:]) % 4 for k in a} == {0, 1, 2, 3}


def test_logistic_against_newton(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x @ [1.0, -2.0] + rng.normal(size=200) > 0.3).astype(int)
    d = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    s = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    for penalised in (False, True):
        w, b = learning.fit_logistic(d, ["a", "b"], "y", penalise_intercept=penalised)
        z, t, pen = np.c_[x, np.ones(200)], np.zeros(3), np.array([1.0, 1.0, float(penalised)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ t))
            t -= np.linalg.solve(z.T @ (z * (s * p * (1 - p))[:, None]) + np.diag(pen), z.T @ (s * (p - y)) + pen * t)
        assert np.allclose([*w, b], t, atol=1e-4)


RULES = {
    "smart_functions": {"terms": ["smart", "wi fi", "alexa", "app control"]},
    "matching": {"generic_switch_fields": ["title", "categories"], "primary_evidence_fields": ["title", "categories", "features"], "identity_gate_fields": ["title", "categories"], "conditional_device_terms": ["power strip"]},
    "devices": {
        "smart_plug": {"terms": ["plug", "power strip"], "strong_identity_terms": ["smart plug"], "eligibility_identity_terms": ["smart plug", "smart power strip"], "wrong_product_terms": ["spark plug"]},
        "smart_switch": {"terms": ["switch"], "strong_identity_terms": ["smart switch"], "eligibility_identity_terms": ["light switch"], "wrong_product_terms": ["network switch"], "required_context_terms": ["wall"]},
    },
    "exclusions": {"accessory_terms": ["wall plate"], "accessory_relation_terms": ["for"], "non_smart_terms": ["non smart"]},
}


@pytest.mark.parametrize(("title", "eligible", "reason"), [
    ("Kasa Wi-Fi Smart Plug with Alexa App Control", ["smart_plug"], None),
    ("Smart Compatible Iridium Spark Plug", [], "smart_plug:wrong_product:spark plug"),
    ("Smart Wall Light Switch", ["smart_switch"], None),
    ("Wall Plate for Smart Light Switch", [], "global:accessory_primary_identity:wall plate"),
    ("Portable Blender with Smart Switch", [], "smart_switch:required_target_context_absent"),
    ("Smart Power Strip with Six Outlets", [], "smart_plug:conditional_without_specific_smart_control_evidence"),
    ("A19 LED Light Bulb 60W", None, None),
])
def test_candidates(spark, title, eligible, reason):
    d = spark.createDataFrame([(title, "", "", "")], "title string, categories string, features string, description string")
    got = classify.analyze_candidates(d, RULES).collect()
    if eligible is None:
        assert not got
    else:
        assert got[0].eligible_device_types == eligible and (reason is None or reason in got[0].exclusion_reasons)


def test_json_profile(spark):
    lines = spark.createDataFrame([(1, '{"a": 1, "b": ""}'), (2, '{"a": null}'), (3, "[1]"), (4, "{bad"), (5, "  "), (6, None)], "k int, line string")
    c = jsonl.scan_counts(lines).first()
    assert (c.physical, c.empty, c.error, c.object, c.non_object) == (6, 2, 1, 2, 1)
    p = {r.field: r for r in jsonl.field_profile(lines, "k").collect()}
    assert p["a"].effective_missing == 1 and p["b"].effective_missing == 2


def test_workbook(tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>ok</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>3</v></c><c r="B2" t="b"><v>1</v></c></row><row><c r="A3"><v>2.5</v></c></row></sheetData></worksheet>')
    assert files.read_workbook(tmp_path / "w.xlsx", "S") == [{"id": 3, "ok": True}, {"id": 2.5, "ok": None}]


def test_contracts(spark):
    d = spark.createDataFrame([(1, 2.0, 0)], "product int, feature_x double, target_y int")
    assert contracts.namespaces(d, ["product"])["features"] == ["feature_x"]
    with pytest.raises(contracts.ContractError):
        contracts.forbid(d, ["FEATURE_X"])
    with pytest.raises(contracts.ContractError):
        contracts.namespaces(d, [])


def test_streaming_append(spark, tmp_path):
    from tidemark.streaming import incremental

    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
        incremental.append_batches(s, str(tmp_path / "out"), str(tmp_path / f"cp{_}"), ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_balanced_select_reads_every_review(spark, monkeypatch):
    from tidemark.plans import facts
    from tidemark.plans import sampling as plans

    sf = "/root/testdata/sf0.01"  # the smallest has no more products
    monkeypatch.setattr(plans.sampling, "balanced_select", lambda pool, *_: pool)
    assert plans.smp_08(spark, sf).count() == facts.reviews(spark, sf).select("order_id", "line_no").distinct().count()


def test_schema_comparison_reads_every_line_once(spark, monkeypatch):
    from tidemark.plans import scanning

    sides = []
    monkeypatch.setattr(scanning.jsonl, "field_profile", lambda lines, _: sides.append(lines.select("event_id")) or lines)
    monkeypatch.setattr(scanning.jsonl, "compare_profiles", lambda one, two: one)
    sf = "/root/testdata/sf0.001"
    scanning.agg_20(spark, sf)
    have = sorted(r.event_id for side in sides for r in side.collect())
    assert have == sorted(r.event_id for r in scanning._lines(spark, sf).select("event_id").collect())


def test_normalisers_outside_ascii(spark):
    assert one(spark, "Ｓｍａｒｔ Ｐｌｕｇ", text.normalize_protocol) == "smart plug"
    assert one(spark, "Ｗｉ-Ｆｉ ofﬁce Straße", text.normalize_protocol) == "wifi office strasse"
    assert one(spark, "Ｓｍａｒｔ＿Ｐｌｕｇ ＆ Straße ½", text.normalize_rule) == "smart plug and strasse 1 2"
    assert one(spark, "Ｎｏｔ　 Ｗorking ﬁne", text.normalize_simple) == "not working fine"
    assert one(spark, "STRASSE ﬁ", text.normalize_for_dedup) == one(spark, "straße FI", text.normalize_for_dedup) == "strasse fi"
    assert [one(spark, None, f) for f in (text.normalize_protocol, text.normalize_rule, text.normalize_simple)] == [""] * 3
    assert text.normalized_term("Ｗｉ-Ｆｉ") == "wifi"


def test_word_boundary_terms(spark):
    f = lambda c: text.word_boundary_terms(c, ["Wi-Fi", "bulb", "a19", "smart bulb"])
    assert one(spark, "wifi smart bulb a190", f) == ["Wi-Fi", "bulb", "smart bulb"]
    assert one(spark, "bulbs", f) == [] and one(spark, "", f) == []


def test_clean_text_changed(spark):
    assert one(spark, "a  b", text.clean_text).changed is True and one(spark, "a b", text.clean_text).changed is False


BULBS = {
    "bulb": {"identity_terms": ["light bulb", "bulb"], "ecosystem_terms": ["hue"], "wrong_terms": ["lamp shade"], "accessory_terms": ["socket"], "collision_terms": ["smart size"]},
    "smart": {"specific_terms": ["Wi-Fi", "alexa", "smart home"], "bluetooth_support_terms": ["app"], "weak_terms": ["smart home"]},
}


def test_bulb_evidence(spark):
    rows = [
        ("Ｗｉ-Ｆｉ LED Light Bulb", "Lighting", "Works with Alexa over Wi-Fi. " + "x" * 500, "For a smart home"),
        ("LED Bulb", "Lighting", "bright", "bluetooth app"),
        ("Bulb", "Lighting", "smart home look", ""),
        ("Socket for bulbs", "Lighting", "alexa", ""),
        ("Smart RGB Bulb", "", None, None),
    ]
    got = classify.classify_bulbs(spark.createDataFrame(rows, "title string, categories string, features string, description string"), BULBS).collect()
    a, b, c, d, e = got
    assert (a.audit_label, a.proposed_decision, a.confidence, a.draft_positive_before_audit) == ("correct_target", "include", "high", True)
    assert a.matched_device_terms == ["bulb", "light bulb"] and a.matched_smart_terms == ["Wi-Fi", "alexa"]
    assert a.supporting_metadata_fields == ["title", "features", "description"]
    assert a.limited_metadata_evidence.startswith("categories: Lighting | features: Works with Alexa over Wi-Fi. xxx") and "… | description: For a smart home" in a.limited_metadata_evidence
    assert a.audit_notes == "Primary bulb identity and specific connected-control evidence are both present."
    assert (b.audit_label, b.confidence, b.matched_smart_terms) == ("correct_target", "medium", ["bluetooth"])
    assert (c.audit_label, c.draft_positive_before_audit, c.matched_smart_terms) == ("non_smart", False, [])
    assert (d.audit_label, d.proposed_decision) == ("accessory", "exclude")
    assert (e.audit_label, e.confidence, e.matched_smart_terms, e.limited_metadata_evidence) == ("correct_target", "high", ["smart_near_bulb"], "")


def test_switch_evidence(spark):
    rules = {"switch": {"identity_terms": ["switch", "dimmer"], "context_terms": ["wall"], "protocol_terms": ["z-wave"], "wrong_terms": ["network"], "accessory_terms": ["cover"], "retrofit_phrases": ["snaps on top"], "rf_only_terms": ["433mhz"], "radio_terms": ["wifi"], "dominant_terms": ["light switch"], "near_words": ["switch"]}, "smart": {"specific_terms": ["alexa"]}}
    rows = [("Z Wave Dimmer", "wall", ["a"]), ("Smart Switch", "", ["a"]), ("Switch cover", "wall", ["a"]), ("Wall switch 433MHz", "", ["a"]), ("Alexa wall switch", "", ["a", "b"])]
    got = classify.classify_switches(spark.createDataFrame(rows, "title string, categories string, candidate_device_types array<string>"), rules).collect()
    assert [(r.audit_label, r.proposed_decision, r.confidence) for r in got] == [("correct_target", "include", "high"), ("insufficient_evidence", "hold", "low"), ("accessory", "exclude", "high"), ("non_smart", "exclude", "high"), ("ambiguous", "hold", "low")]
    assert got[0].matched_smart_terms == ["z-wave"] and got[1].matched_smart_terms == ["smart_near_switch"] and got[0].draft_positive_before_audit and not got[1].draft_positive_before_audit
    assert got[0].supporting_metadata_fields == ["title", "categories"] and got[0].limited_metadata_evidence == "categories: wall"


def test_candidate_reason(spark):
    import json

    d = spark.createDataFrame([("Kasa Ｓｍａｒｔ Plug", "Outlets", "plug with alexa", "")], "title string, categories string, features string, description string")
    r = classify.analyze_candidates(d, RULES | {"filter": {"candidate_term_policy": "smart_and_device"}}).first()
    assert r.matched_fields == ["features", "title"] and r.eligible_after_exclusions is True and r.candidate_confidence == "high"
    assert json.loads(r.candidate_reason) == {"policy": "smart_and_device", "device_types": ["smart_plug"], "eligible_device_types": ["smart_plug"], "matched_fields": ["features", "title"], "smart_matched_fields": ["features", "title"], "title_only": False, "ambiguity_status": "single_device_type"}


def test_error_lines_offsets(spark):
    from pyspark.sql.types import StructType  # noqa: F401

    lines = ['{"a": 1}', "", '{"é": ', "[1, 2", "nope", '{"a": 1,}', '{"b": null}']
    d = spark.createDataFrame(list(enumerate(lines)), "n int, line string").repartition(3)
    got = {r.n: (r.line_no, r.byte_offset, r.category) for r in jsonl.error_lines(d, "n").collect()}
    at = [sum(len(x.encode()) + 1 for x in lines[:i]) for i in range(len(lines))]
    assert got == {2: (3, at[2], "unclosed_object"), 3: (4, at[3], "malformed_array"), 4: (5, at[4], "malformed_value"), 5: (6, at[5], "malformed_object")}


def test_field_profile_of_empty_objects(spark):
    d = spark.createDataFrame([(1, "{}"), (2, '{"a": ""}'), (3, '{"b": 1, "a": null}'), (4, "bad"), (5, "[]")], "n int, line string")
    got = {r.field: r for r in jsonl.field_profile(d, "n").collect()}
    assert set(got) == {"a", "b"} and got["a"].objects == 3 and (got["a"].present, got["a"].n_null, got["a"].n_string, got["a"].n_empty, got["a"].effective_missing) == (2, 1, 1, 1, 3)
    assert (got["b"].present, got["b"].n_integer, got["b"].effective_missing) == (1, 1, 2)


def test_prefix_changes(spark):
    base = spark.createDataFrame([(i, float(i)) for i in range(40)], "k int, v double")
    more = spark.createDataFrame([(i, float(i), 1) for i in range(100, 120)], "k int, v double, late int")
    same = base.withColumn("late", F.lit(0)).unionByName(more)
    check = lambda c: audits.prefix_changes(base, ["k"], c, ["late", "k"]).first()
    assert tuple(check(same)) == (40, 60, 0)
    assert check(same.withColumn("v", F.when(F.col("k") == 7, 0.5).otherwise(F.col("v")))).n_changed == 1
    assert check(same.where("k <> 39 AND k < 100")).n_changed == 1 and check(same.where("k <> 0 AND k < 100")).n_changed == 40


def test_mapped_refuses_unknown_keys(spark):
    f = lambda c: maths.mapped(c, {"a": "x", "b": "y"})
    assert one(spark, "b", f) == "y"
    for bad in ("c", None):
        with pytest.raises(Exception, match="no value for"):
            one(spark, bad, f)


def test_bucket_mix_fallback(spark):
    import itertools

    kinds = list(itertools.chain(*([b] * n for b, n in zip(sampling.BUCKETS, (3, 40, 60), strict=True))))
    pool = spark.createDataFrame([(i, b, i % 7, f"s{i % 3}") for i, b in enumerate(kinds)], "k int, bucket string, parent int, stratum string").repartition(5)
    shares = dict(zip(sampling.BUCKETS, (0.5, 0.25, 0.25), strict=True))
    mix = lambda p, n: {(r.k, r.stage) for r in sampling.bucket_mix(p, n, shares, 5, "t", "parent", "k", ["stratum"]).collect()}
    got = mix(pool, 40)
    assert len(got) == 40 and sum(s == "bucket" for _, s in got) == 3 + 10 + 10 and got == mix(pool.repartition(2), 40)
    taken = {k for k, s in got if s == "bucket"}
    h = lambda *p: hashlib.sha256("\0".join(["5", *p]).encode()).hexdigest()
    rest = sorted((h("t|fallback", str(i)), i) for i in range(len(kinds)) if i not in taken)
    turn = {}
    order = []
    for rh, i in rest:
        order.append((turn.setdefault(i % 7, 0), h("t|fallback|stratum", f"s{i % 3}"), rh, i))
        turn[i % 7] += 1
    assert {k for k, s in got if s == "fallback"} == {x[-1] for x in sorted(order)[:17]}
    with pytest.raises(ValueError, match="fewer"):
        mix(pool, 200)


def test_balanced_selection_needs_only_what_it_keeps(spark):
    import random

    rng = random.Random(3)
    rows = [("g", i, f"p{rng.randrange(60)}", rng.random() < 0.3, rng.choice(list(sampling.RATING_SHARES)), rng.choice(list(sampling.TIME_SHARES))) for i in range(1500)]
    pool = spark.createDataFrame(rows, "g string, duplicate_key long, parent_asin string, keyword_candidate_hit boolean, rating_stratum string, time_stratum string")
    got = [r.duplicate_key for r in sampling.balanced_select(pool, 25, 11, "t", "g").orderBy("place").collect()]
    order = {r.duplicate_key: r.o for r in pool.select("duplicate_key", sampling.seeded_order(11, F.lit("t"), F.col("duplicate_key")).alias("o")).collect()}
    whole = [{"g": g, "duplicate_key": k, "parent_asin": p, "keyword_candidate_hit": h, "rating_stratum": r, "time_stratum": t, "order": order[k]} for g, k, p, h, r, t in rows]
    assert got == [r["duplicate_key"] for r in sampling.greedy_balance(whole, 25)]


def test_ranked_metrics_by_key(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(2), rng.randrange(12) / 10) for _ in range(400)]
    d = spark.createDataFrame(rows, "k string, y int, s double")
    auc = {r.k: r.roc_auc for r in metrics.roc_auc(d, "y", "s", ["k"]).collect()}
    ap = {r.k: r.average_precision for r in metrics.average_precision(d, "y", "s", ["k"]).collect()}
    for k in "abc":
        pos, neg = ([s for a, y, s in rows if a == k and y == v] for v in (1, 0))
        assert abs(auc[k] - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-12
        want = sum((sum(p >= t for p in pos) / (sum(p >= t for p in pos) + sum(n >= t for n in neg))) * sum(p == t for p in pos) for t in set(pos)) / len(pos)
        assert abs(ap[k] - want) < 1e-12


def test_svm_against_newton(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(scale=1.5, size=300) > 0.8).astype(int)
    w, b = learning.fit_svm(spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y int"), ["a", "b", "c"], "y", 0.7)
    z, s = np.c_[x, np.ones(300)], np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    loss = lambda v: v @ v / 2 + 0.7 * (weight * np.maximum(0, 1 - s * (z @ v)) ** 2).sum()
    found = np.array([*w, b])
    gap = np.maximum(0, 1 - s * (z @ found))
    assert np.abs(found - 2 * 0.7 * z.T @ (weight * s * gap)).max() < 1e-6  # the gradient is nought, and the loss convex
    assert all(loss(found) <= loss(found + rng.normal(scale=0.01, size=4)) for _ in range(50))


def test_batch_inference_resumes(spark, tmp_path):
    d = spark.createDataFrame([(i, i / 50 - 1) for i in range(100)], "k int, x double")
    path, model = f"file://{tmp_path}/scores", ([2.0], 0.5)
    first = {r.k: r.score for r in learning.batch_inference(d, ["x"], model, ["k"], path, 4).collect()}
    assert len(first) == 100 and abs(first[50] - 1 / (1 + 2.718281828459045**-0.5)) < 1e-9
    kept = sorted((tmp_path / "scores/scores/chunk=1").iterdir())
    (tmp_path / "scores/scores/chunk=2/_SUCCESS").unlink()  # as if the run had been cut off there
    assert {r.k: r.score for r in learning.batch_inference(d, ["x"], model, ["k"], path, 4).collect()} == first
    assert sorted((tmp_path / "scores/scores/chunk=1").iterdir()) == kept
    for other in ([2.1], 0.5), ([2.0], 0.4):
        with pytest.raises(learning.FrozenModelError):
            learning.batch_inference(d, ["x"], other, ["k"], path, 4)


def test_sentiment_rules(spark):
    from tidemark.operators import sentiment

    lex = {"good": 1.9, "great": 3.1, "bad": -2.5, "horrible": -2.5, "love": 3.2, "kind": 2.4}
    c = lambda t: sentiment.polarity(t, lex)[0]
    assert c("") == 0 and c("the table") == 0 and c(None) == 0
    assert abs(c("good") - 1.9 / (1.9**2 + 15) ** 0.5) < 1e-4
    assert c("very good") > c("good") > c("slightly good") > 0 > c("not good") > c("bad")
    assert c("GOOD product") > c("good product") and c("GOOD") == c("good")
    assert c("good!!!") > c("good!") > c("good") and c("good???") > c("good??") > c("good?") == c("good")
    assert c("good but horrible") < 0 < c("horrible but good") + 0.5 and c("at least good") > 0 > c("least good")
    assert c("never so good") > c("good") and c("isn't good") < 0 and c("kind of table") == 0
    pos, neu, neg = sentiment.polarity("good bad table", lex)[1:]
    assert abs(pos + neu + neg - 1) < 0.002 and neg > pos > 0
    r = one(spark, "very good", lambda x: sentiment.sentiment(x, lex))
    assert tuple(r) == sentiment.polarity("very good", lex)


def test_language_detection(spark):
    from tidemark.operators import languages

    text_of = {"en": "the thing that they were with and from the other house", "de": "der die und nicht mit einer von ihrer schön straße", "fr": "les une dans avec pour être très déjà où cette"}
    rows = [(f"{k}{i}", " ".join(v.split()[i % 3 :]) + " " + v, k) for k, v in text_of.items() for i in range(6)]
    d = spark.createDataFrame(rows, "id string, text string, lang string")
    more = spark.createDataFrame([("x1", "they were with the other", "?"), ("x2", "nicht mit der straße", "?"), ("x3", "avec cette", "?"), ("x4", "12345", "?"), ("x5", None, "?"), (None, "they were", "?")], d.schema)
    got = {r.id: (r.detected, r.confidence) for r in languages.detect(d.unionByName(more), "id", "text", languages.fit_profiles(d, "text", "lang")).collect()}
    assert len(got) == 24 and all(v[0] == k[:2] for k, v in got.items() if k and k[0] != "x")
    assert [got[x][0] for x in ("x1", "x2", "x3", "x4", "x5")] == ["en", "de", "fr", None, None]
    assert got["x1"][1] > 0.9 > 0.1 > got["x2"][1]
