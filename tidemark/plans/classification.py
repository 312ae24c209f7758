"""Rule classification of products drawn from the part table, with a small rule set of its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify
from ..sources.batches import spread
from ..storage import cut
from .facts import table
from .registry import query

WORDS = {"smart_plug": "bolt", "smart_bulb": "ring", "smart_switch": "gear"}
RULES = {
    "smart_functions": {"terms": ["red", "blue", "smart"]},
    "matching": {"generic_switch_fields": ["title", "categories"], "primary_evidence_fields": ["title", "categories", "features"], "identity_gate_fields": ["title", "categories"], "conditional_device_terms": ["ring"]},
    "devices": {k: {"terms": [w, "widget"], "strong_identity_terms": [f"red {w}"], "eligibility_identity_terms": [w], "wrong_product_terms": ["promo"]} for k, w in WORDS.items()},
    "exclusions": {"accessory_terms": ["widget"], "accessory_relation_terms": ["for"], "non_smart_terms": ["hot"]},
}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("categories"), F.col("p_brand").alias("features"), F.lit("").alias("description"))


def _has(text: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains(' ' || {text} || ' ', ' {t} ')" for t in terms) + ")"


_N = "SELECT p_partkey, lower(p_name) AS t, lower(p_type) AS ty, lower(p_name || ' ' || p_type) AS tc FROM part"
# the reasons of the rule set above, spelt out
_X = {k: f"""list_sort(list_filter([CASE WHEN {_has('t', 'hot')} THEN 'global:explicit_non_smart:hot' END, CASE WHEN acc THEN 'global:accessory_primary_identity:widget' END, CASE WHEN {_has('tc', 'promo')} THEN '{k}:wrong_product:promo' END, CASE WHEN NOT {_has('tc', w)} THEN '{k}:approved_identity_phrase_absent' END,
 CASE WHEN {_has('tc', 'ring')} AND NOT {_has('tc', 'red', 'blue')} THEN '{k}:conditional_without_specific_smart_control_evidence' END], lambda x: x IS NOT NULL))""" for k, w in sorted(WORDS.items())}
CAND = f"""n AS ({_N}), s AS (SELECT * FROM n WHERE {_has('tc', 'red', 'blue', 'smart')}), c AS (SELECT *, {', '.join(f"{_has('tc', w, 'widget')} AS c_{k}" for k, w in WORDS.items())} FROM s), a AS (SELECT *, {_has('t', 'widget')} AND ({_has('t', 'for')} OR NOT ({' OR '.join(f"c_{k} AND {_has('t', f'red {w}')}" for k, w in WORDS.items())})) AS acc FROM c WHERE {' OR '.join(f'c_{k}' for k in WORDS)}),
 x AS (SELECT *, {', '.join(f"CASE WHEN c_{k} THEN {e} ELSE [] END AS x_{k}" for k, e in _X.items())} FROM a),
 r AS (SELECT *, list_filter([{', '.join(f"CASE WHEN c_{k} THEN '{k}' END" for k in sorted(WORDS))}], lambda v: v IS NOT NULL) AS types, list_filter([{', '.join(f"CASE WHEN c_{k} AND len(x_{k}) = 0 THEN '{k}' END" for k in sorted(WORDS))}], lambda v: v IS NOT NULL) AS el FROM x)"""


@query("cls_01_candidates", f"""WITH {CAND} SELECT p_partkey, array_to_string(types, ';') AS candidates, array_to_string(el, ';') AS eligible, array_to_string(list_sort(list_distinct(flatten([{', '.join(f'x_{k}' for k in WORDS)}]))), ';') AS reasons,
 CASE WHEN len(types) > 1 AND len(el) = 1 THEN 'resolved_by_explicit_exclusion' WHEN len(types) > 1 THEN 'unresolved_multiple_device_types' ELSE 'single_device_type' END AS ambiguity_status,
 CASE WHEN len(el) = 0 THEN 'excluded' WHEN len(el) > 1 THEN 'ambiguous' WHEN {' OR '.join(f"list_contains(el, '{k}') AND {_has('t', f'red {w}')}" for k, w in WORDS.items())} THEN 'high' WHEN {' OR '.join(f"list_contains(el, '{k}') AND {_has('t', w, 'widget')}" for k, w in WORDS.items())} THEN 'medium' ELSE 'borderline' END AS candidate_confidence,
 concat_ws(';', CASE WHEN {_has('ty', 'red', 'blue', 'smart', 'widget', *WORDS.values())} THEN 'categories' END, CASE WHEN {_has('t', 'red', 'blue', 'smart', 'widget', *WORDS.values())} THEN 'title' END) AS matched_fields, len(el) = 1 AS eligible_after_exclusions, CASE WHEN len(el) = 1 THEN el[1] WHEN len(el) > 1 THEN 'ambiguous' ELSE 'excluded' END AS provisional_device_type FROM r""")
def cls_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = classify.analyze_candidates(_records(spark, sf_dir), RULES)
    return d.select("p_partkey", F.array_join("candidate_device_types", ";").alias("candidates"), F.array_join("eligible_device_types", ";").alias("eligible"), F.array_join("exclusion_reasons", ";").alias("reasons"), "ambiguity_status", "candidate_confidence", F.array_join("matched_fields", ";").alias("matched_fields"), "eligible_after_exclusions", "provisional_device_type")


RECALL = {
    "bulb": {"identity_terms": ["ring", "widget"], "ecosystem_terms": ["large"], "wrong_terms": ["gear"], "accessory_terms": ["small"], "collision_terms": ["hot"]},
    "switch": {"identity_terms": ["gear", "widget"], "context_terms": ["standard", "large", "promo"], "protocol_terms": ["blue"], "wrong_terms": ["ring"], "accessory_terms": ["bolt"], "retrofit_phrases": ["red bolt"], "rf_only_terms": ["hot"], "radio_terms": ["wifi"], "dominant_terms": ["gear"], "near_words": ["gear"]},
    "smart": {"specific_terms": ["red", "blue"], "bluetooth_support_terms": ["app"], "weak_terms": ()},
}


@query("cls_02_bulb_recall", f"""WITH n AS ({_N}) SELECT p_partkey, CASE WHEN {_has('t', 'small')} THEN 'accessory' WHEN {_has('t', 'gear')} THEN 'wrong_device_type' WHEN {_has('t', 'hot')} AND NOT {_has('tc', 'red', 'blue')} THEN 'non_smart' WHEN NOT {_has('tc', 'ring', 'widget')} THEN 'insufficient_evidence'
 WHEN NOT {_has('tc', 'red', 'blue', 'large')} OR {_has('t', 'hot')} THEN 'non_smart' ELSE 'correct_target' END AS audit_label, {_has('tc', 'ring', 'widget')} AND {_has('tc', 'red', 'blue', 'large')} AND NOT {_has('t', 'small', 'gear')} AND NOT ({_has('t', 'hot')} AND NOT {_has('tc', 'red', 'blue')}) AS draft_positive, array_to_string(list_filter(['ring', 'widget'], lambda v: contains(' ' || tc || ' ', ' ' || v || ' ')), ';') AS device_terms, array_to_string(list_filter(['blue', 'large', 'red'], lambda v: contains(' ' || tc || ' ', ' ' || v || ' ')), ';') AS smart_terms FROM n""")
def cls_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_bulbs(_records(spark, sf_dir), RECALL).select("p_partkey", "audit_label", F.col("draft_positive_before_audit").alias("draft_positive"), F.array_join("matched_device_terms", ";").alias("device_terms"), F.array_join("matched_smart_terms", ";").alias("smart_terms"))


SWITCH_LABEL = f"""CASE WHEN {_has('t', 'bolt')} AND NOT contains(tc, 'red bolt') THEN 'accessory' WHEN {_has('t', 'ring')} THEN 'wrong_device_type' WHEN {_has('tc', 'hot')} AND NOT {_has('tc', 'red', 'blue', 'wifi')} THEN 'non_smart' WHEN NOT {_has('tc', 'gear', 'widget')} THEN 'insufficient_evidence'
 WHEN NOT {_has('tc', 'standard', 'large', 'promo')} THEN 'insufficient_evidence' WHEN NOT {_has('tc', 'red', 'blue')} THEN 'non_smart' ELSE 'correct_target' END"""
SWITCH_DECISION = f"""CASE WHEN {SWITCH_LABEL} = 'correct_target' THEN 'include' WHEN {SWITCH_LABEL} = 'insufficient_evidence' AND {_has('tc', 'gear', 'widget')} AND {_has('tc', 'red', 'blue')} THEN 'hold' ELSE 'exclude' END"""


@query("cls_03_switch_recall", f"WITH n AS ({_N}) SELECT p_partkey, {SWITCH_LABEL} AS audit_label, {SWITCH_DECISION} AS proposed_decision, array_to_string(list_filter(['gear', 'widget'], lambda v: contains(' ' || tc || ' ', ' ' || v || ' ')), ';') AS device_terms, array_to_string(list_filter(['blue', 'red'], lambda v: contains(' ' || tc || ' ', ' ' || v || ' ')), ';') AS smart_terms FROM n")
def cls_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_switches(_records(spark, sf_dir), RECALL).select("p_partkey", "audit_label", "proposed_decision", F.array_join("matched_device_terms", ";").alias("device_terms"), F.array_join("matched_smart_terms", ";").alias("smart_terms"))


@query("cls_04_gate_categories", f"""WITH {CAND}, z AS (SELECT p_partkey, types, list_sort(list_distinct(flatten([{', '.join(f'x_{k}' for k in WORDS)}]))) AS reasons FROM r)
 SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_transform(list_filter(reasons, lambda v: starts_with(v, 'smart_bulb:')), lambda v: CASE WHEN starts_with(v, 'smart_bulb:wrong_product:') THEN 'wrong_product' ELSE substr(v, 12) END), list_filter([CASE WHEN len(list_filter(reasons, lambda v: starts_with(v, 'global:accessory'))) > 0 THEN 'accessory' END, CASE WHEN len(types) > 1 THEN 'multi-type conflict' END], lambda v: v IS NOT NULL)))), ';') AS gates FROM z""")
def cls_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = classify.analyze_candidates(_records(spark, sf_dir), RULES)
    return d.select("p_partkey", F.array_join(classify.gate_categories(F.col("exclusion_reasons"), F.col("candidate_device_types"), "smart_bulb"), ";").alias("gates"))


@query("cls_05_conflicts", """WITH d AS (SELECT l_partkey, l_returnflag AS kind, CASE WHEN max(l_quantity) > 45 THEN 'include' ELSE 'exclude' END AS decision FROM lineitem GROUP BY 1, 2), c AS (SELECT l_partkey FROM d WHERE decision = 'include' GROUP BY 1 HAVING count(DISTINCT kind) > 1) SELECT d.l_partkey, kind, CASE WHEN decision = 'include' AND c.l_partkey IS NOT NULL THEN 'hold' ELSE decision END AS decision FROM d LEFT JOIN c ON d.l_partkey = c.l_partkey""")
def cls_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("kind")).agg(F.when(F.max("l_quantity") > 45, "include").otherwise("exclude").alias("decision"))
    return classify.demote_conflicts(d, "l_partkey", "kind", "decision").select("l_partkey", "kind", "decision")


@query("cls_06_audit_decisions", "SELECT p_partkey, CASE WHEN p_partkey IN (3, 5, 8, 13, 21) THEN 'false_positive' WHEN p_partkey IN (1, 2) THEN 'ambiguous' ELSE 'correct_target' END AS audit_label FROM part")
def cls_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k.isin(3, 5, 8, 13, 21), "false_positive").when(k.isin(1, 2), "ambiguous").otherwise("correct_target").alias("audit_label"))


@query("rpt_03_gate_pivot", f"""WITH {CAND}, z AS (SELECT unnest(list_distinct(flatten([{', '.join(f'x_{k}' for k in WORDS)}]))) AS reason, len(el) = 0 AS out FROM r), g AS (SELECT unnest(['explicit_non_smart', 'accessory_primary_identity', 'wrong_product', 'approved_identity_phrase_absent', 'never_seen']) AS gate), h AS (SELECT string_split(reason, ':')[2] AS gate, count(*) AS n, count(*) FILTER (WHERE out) AS n_out FROM z GROUP BY 1) SELECT g.gate, coalesce(n, 0) AS n, coalesce(n_out, 0) AS n_excluded FROM g LEFT JOIN h ON g.gate = h.gate""")
def rpt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(classify.analyze_candidates(_records(spark, sf_dir), RULES).select("exclusion_reasons", "eligible_device_types"))  # else the generator's inferred filter repeats the whole analysis
    z = d.select(F.explode("exclusion_reasons").alias("reason"), (F.size("eligible_device_types") == 0).alias("out"))
    h = z.groupBy(F.element_at(F.split("reason", ":"), 2).alias("gate")).agg(F.count("*").alias("n"), F.count_if("out").alias("k"))
    g = spark.createDataFrame([(x,) for x in ("explicit_non_smart", "accessory_primary_identity", "wrong_product", "approved_identity_phrase_absent", "never_seen")], "gate string")
    return g.join(h, "gate", "left").select("gate", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("k", F.lit(0)).cast("long").alias("n_excluded"))
