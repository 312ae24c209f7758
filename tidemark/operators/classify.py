"""Product classification by rules.  Rules are data (see sources.files.load_toml); decisions are column expressions.

Rules for candidates: smart_functions.terms, matching.{generic_switch_fields, primary_evidence_fields,
identity_gate_fields, conditional_device_terms}, devices.<type>.{terms, strong_identity_terms,
eligibility_identity_terms, wrong_product_terms[, required_context_terms]} and exclusions.{accessory_terms,
accessory_relation_terms, non_smart_terms}.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, matching_terms, normalize_protocol, normalize_rule, normalized_term, snippet_at, within_tokens

FIELDS = ("title", "categories", "features", "description")


def _any(cs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs, F.lit(False))


def _union(cs: Sequence[Column]) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*cs))))


def _some(c: Column) -> Column:
    return F.size(c) > 0


def _tagged(prefix: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(prefix), t))


def _if(cond: Column, reason: str) -> Column:
    return F.when(cond, F.array(F.lit(reason))).otherwise(F.array().cast("array<string>"))


def analyze_candidates(records: DataFrame, rules: Mapping, bare_switch: tuple[str, str] = ("smart_switch", "switch")) -> DataFrame:
    """records (title, categories, features, description as text) that name a smart function and a device, with their
    candidate and eligible types, terms, matched fields, exclusion reasons, ambiguity, confidence and, as JSON, the reason.

    The first gate (a smart term in some field) is a filter, so device terms are looked for in few records.
    """
    kinds = sorted(rules["devices"])
    m = rules["matching"]
    d = records.withColumns({f"__n_{f}": normalize_rule(F.col(f)) for f in FIELDS})
    smart_terms = rules["smart_functions"]["terms"]
    d = d.withColumns({f"__s_{f}": matching_terms(F.col(f"__n_{f}"), smart_terms) for f in FIELDS})
    d = d.withColumn("candidate_smart_terms", _union([F.col(f"__s_{f}") for f in FIELDS])).where(F.size("candidate_smart_terms") > 0)

    def device_terms(kind: str, field: str) -> Column:
        terms = list(rules["devices"][kind]["terms"])
        if kind == bare_switch[0] and field not in m["generic_switch_fields"]:
            terms = [t for t in terms if t != bare_switch[1]]
        return matching_terms(F.col(f"__n_{field}"), terms)

    d = d.withColumns({f"__d_{k}_{f}": device_terms(k, f) for k in kinds for f in FIELDS})
    d = d.withColumns({f"__c_{k}": _any([_some(F.col(f"__d_{k}_{f}")) for f in FIELDS]) for k in kinds})
    d = d.withColumn("candidate_device_types", F.array_compact(F.array(*(F.when(F.col(f"__c_{k}"), k) for k in kinds)))).where(F.size("candidate_device_types") > 0)
    title, both = F.col("__n_title"), F.trim(F.concat_ws(" ", "__n_title", "__n_categories"))
    accessory, relation = matching_terms(title, rules["exclusions"]["accessory_terms"]), matching_terms(title, rules["exclusions"]["accessory_relation_terms"])
    strong_title = _any([F.col(f"__c_{k}") & _some(matching_terms(title, rules["devices"][k]["strong_identity_terms"])) for k in kinds])
    none = F.array().cast("array<string>")
    d = d.withColumn("__global", F.concat(_tagged("global:explicit_non_smart:", matching_terms(title, rules["exclusions"]["non_smart_terms"])), F.when(_some(accessory) & (_some(relation) | ~strong_title), _tagged("global:accessory_primary_identity:", accessory)).otherwise(none)))
    gate = m["identity_gate_fields"]
    gate_smart = _any([_some(F.col(f"__s_{f}")) for f in gate])
    specific = _some(F.filter("candidate_smart_terms", lambda t: t != "smart"))
    for k in kinds:
        r = rules["devices"][k]
        gate_device = _any([_some(F.col(f"__d_{k}_{f}")) for f in gate])
        strong = _some(matching_terms(both, r["strong_identity_terms"]))
        reasons = [
            F.col("__global"),
            _tagged(f"{k}:wrong_product:", matching_terms(both, r["wrong_product_terms"])),
            _if(~_some(matching_terms(both, r["eligibility_identity_terms"])), f"{k}:approved_identity_phrase_absent"),
            _if(~gate_device, f"{k}:identity_not_in_title_or_categories"),
            _if(gate_device & ~strong & ~gate_smart, f"{k}:smart_evidence_not_in_title_or_categories"),
            _if(_some(matching_terms(both, m["conditional_device_terms"])) & ~specific, f"{k}:conditional_without_specific_smart_control_evidence"),
        ]
        if r.get("required_context_terms"):
            reasons.append(_if(~_some(matching_terms(both, r["required_context_terms"])), f"{k}:required_target_context_absent"))
        d = d.withColumn(f"__x_{k}", F.when(F.col(f"__c_{k}"), _union(reasons)).otherwise(none))
    eligible = {k: F.col(f"__c_{k}") & (F.size(f"__x_{k}") == 0) for k in kinds}
    d = d.withColumn("eligible_device_types", F.array_compact(F.array(*(F.when(c, k) for k, c in eligible.items()))))
    d = d.withColumn("exclusion_reasons", _union([F.col(f"__x_{k}") for k in kinds]))
    n, e = F.size("candidate_device_types"), F.size("eligible_device_types")
    d = d.withColumn("ambiguity_status", F.when((n > 1) & (e == 1), "resolved_by_explicit_exclusion").when(n > 1, "unresolved_multiple_device_types").otherwise("single_device_type"))
    high = _any([eligible[k] & _some(matching_terms(title, rules["devices"][k]["strong_identity_terms"])) for k in kinds])
    primary_smart = _any([_some(F.col(f"__s_{f}")) for f in m["primary_evidence_fields"]])
    medium = _any([eligible[k] & _some(F.col(f"__d_{k}_title")) for k in kinds]) & primary_smart
    d = d.withColumn("candidate_confidence", F.when(e == 0, "excluded").when(e > 1, "ambiguous").when(high, "high").when(medium, "medium").otherwise("borderline"))
    d = d.withColumn("provisional_device_type", F.when(e == 1, F.element_at("eligible_device_types", 1)).when(e > 1, "ambiguous").otherwise("excluded"))
    outside = _any([_some(F.col(f"__s_{f}")) | _any([_some(F.col(f"__d_{k}_{f}")) for k in kinds]) for f in FIELDS if f != "title"])
    named = {f: _any([_some(F.col(f"__d_{k}_{f}")) for k in kinds]) for f in FIELDS}
    having = lambda test: F.array_compact(F.array(*(F.when(test(f), f) for f in sorted(FIELDS))))
    d = d.withColumns({"smart_matched_fields": having(lambda f: _some(F.col(f"__s_{f}"))), "matched_fields": having(lambda f: _some(F.col(f"__s_{f}")) | named[f]), "eligible_after_exclusions": e == 1})
    d = d.withColumn("candidate_device_terms", _union([F.when(F.col(f"__c_{k}"), F.col(f"__d_{k}_{f}")).otherwise(none) for k in kinds for f in FIELDS])).withColumn("title_only", ~outside)
    reason = F.struct("ambiguity_status", F.col("candidate_device_types").alias("device_types"), "eligible_device_types", "matched_fields", F.lit(rules.get("filter", {}).get("candidate_term_policy")).alias("policy"), "smart_matched_fields", "title_only")
    d = d.withColumn("candidate_reason", F.to_json(reason, {"ignoreNullFields": "false"}))
    return d.drop("smart_matched_fields", *[c for c in d.columns if c.startswith("__")])


RECALL_FIELDS = ("title", "main_category", "categories", "features", "description", "store", "details")
EVIDENCE_FIELDS, EVIDENCE_CHARS, EVIDENCE_ENOUGH = ("categories", "features", "description", "details"), 700, 620


def _decided(cases: Sequence[tuple]) -> dict[str, Column]:
    """Label, decision, confidence and note of the first case that holds."""
    pick = lambda i: F.coalesce(*(F.when(c[0], c[i] if isinstance(c[i], Column) else F.lit(c[i])) for c in cases))
    return {"audit_label": pick(1), "proposed_decision": pick(2), "confidence": pick(3), "audit_notes": pick(4)}


class _Recall:
    """The normalised texts of records and the terms found in them; terms are looked for in their normalised form."""

    def __init__(self, records: DataFrame):
        have = [n for n in RECALL_FIELDS if n in records.columns]
        self.d = records.withColumns({f"__n_{n}": normalize_protocol(F.col(n)) if n in have else F.lit("") for n in RECALL_FIELDS})
        self.have = have
        self.title, self.categories = F.col("__n_title"), F.col("__n_categories")
        self.both = F.trim(F.concat_ws(" ", "__n_title", "__n_categories"))
        self.more = F.concat_ws(" ", *(f"__n_{n}" for n in RECALL_FIELDS[3:]))
        self.all = F.trim(F.concat_ws(" ", self.both, self.more))
        self.multi = F.coalesce(F.size("candidate_device_types") > 1, F.lit(False)) if "candidate_device_types" in records.columns else F.lit(False)

    @staticmethod
    def terms(text: Column, terms: Sequence[str]) -> Column:
        """The terms, as they were given, that a normalised text holds as whole words, sorted."""
        known = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(f" {normalized_term(t)} ").alias("n")) for t in sorted(set(terms)) if normalized_term(t)))
        if not any(map(normalized_term, terms)):
            return F.array().cast("array<string>")
        padded = F.concat(F.lit(" "), text, F.lit(" "))
        return F.transform(F.filter(known, lambda x: F.contains(padded, x["n"])), lambda x: x["t"])

    def hit(self, text: Column, terms: Sequence[str]) -> Column:
        return _some(matching_terms(text, [n for t in terms if (n := normalized_term(t))]))

    def finish(self, decided: dict[str, Column], draft: Column, support: Sequence[str], device: Column, context: Column, smart: Column, others: Sequence[str]) -> DataFrame:
        """Decisions, then evidence: fields that hold a term of support, terms found (of support and others), and text around them."""
        d = self.d.withColumns({**decided, "draft_positive_before_audit": draft, "matched_device_terms": device, "matched_smart_terms": smart, "__context": context})
        d = d.withColumn("supporting_metadata_fields", F.array_compact(F.array(*(F.when(self.hit(F.col(f"__n_{n}"), support), n) for n in RECALL_FIELDS))))
        spelt = F.create_map(*(F.lit(x) for t in sorted({*support, *others}) for x in (t, normalized_term(t))))
        terms = F.transform(_union([F.col(c) for c in ("matched_device_terms", "__context", "matched_smart_terms")]), lambda t: F.element_at(spelt, t))
        d = d.withColumns({f"__c_{n}": collapse(F.coalesce(F.col(n), F.lit(""))) for n in EVIDENCE_FIELDS if n in self.have} | {"__terms": terms})
        evidence = F.lit("")
        for n in EVIDENCE_FIELDS:
            if n in self.have:
                part = F.concat(F.lit(f"{n}: "), snippet_at(F.col(f"__c_{n}"), F.col(f"__n_{n}"), F.col("__terms")))
                take = (F.length(evidence) < EVIDENCE_ENOUGH) & (F.col(f"__c_{n}") != "")
                d = d.withColumn(f"__e_{n}", F.when(take, F.concat(evidence, F.when(evidence == "", "").otherwise(" | "), part)).otherwise(evidence))
                evidence = F.col(f"__e_{n}")
        d = d.withColumn("limited_metadata_evidence", F.substring(evidence, 1, EVIDENCE_CHARS))
        return d.drop(*[c for c in d.columns if c.startswith("__")])


# fixed values: words for a bulb that "smart" or a supporting word may stand near
BULB_WORDS, BLUETOOTH_WORDS = ("bulb", "bulbs"), ("bulb", "bulbs", "playbulb")


def classify_bulbs(records: DataFrame, rules: Mapping, sockets: Sequence[str] = BULB_WORDS) -> DataFrame:
    """records with audit_label, proposed_decision, confidence, audit_notes, draft_positive_before_audit, the device and
    smart terms found, supporting_metadata_fields and limited_metadata_evidence for smart bulbs.

    rules: bulb.{identity_terms, ecosystem_terms, wrong_terms, accessory_terms, collision_terms},
    smart.{specific_terms, bluetooth_support_terms, weak_terms}; sockets: words that "smart" may stand near.
    """
    b, s, r = rules["bulb"], rules["smart"], _Recall(records)
    hit, title = r.hit, r.title
    near = within_tokens(title, ["smart"], list(sockets), 6)
    title_device, title_smart, aux_smart = hit(title, b["identity_terms"]), hit(r.both, s["specific_terms"]), hit(r.more, s["specific_terms"])
    strong_terms = [t for t in s["specific_terms"] if normalized_term(t) not in s.get("weak_terms", ())]
    bluetooth = hit(r.all, ["bluetooth"]) & (hit(r.all, s["bluetooth_support_terms"]) | within_tokens(title, ["smart"], list(BLUETOOTH_WORDS), 6))
    smart = title_smart | hit(r.more, strong_terms) | bluetooth | near | hit(r.all, b["ecosystem_terms"])
    identity = title_device | hit(r.categories, b["identity_terms"])
    collision, accessory, wrong = hit(title, b["collision_terms"]), hit(title, b["accessory_terms"]) & ~near, hit(title, b["wrong_terms"])
    barred = accessory | wrong | (collision & ~(title_smart | aux_smart))
    prohibited = "Primary title/category identifies a prohibited product or accessory."
    decided = _decided([
        (accessory, "accessory", "exclude", "high", prohibited),
        (wrong, "wrong_device_type", "exclude", "high", prohibited),
        (barred, "non_smart", "exclude", "high", prohibited),
        (~identity, "insufficient_evidence", "exclude", "low", "Bulb identity is not explicit in title/categories."),
        (~smart | collision, "non_smart", "exclude", F.when(collision, "high").otherwise("medium"), "Bulb identity is present but connected-control evidence is absent."),
        (r.multi & ~title_device, "ambiguous", "hold", "low", "Multiple device identities are present without a dominant bulb title."),
        (F.lit(True), "correct_target", "include", F.when(title_smart | near, "high").otherwise("medium"), "Primary bulb identity and specific connected-control evidence are both present."),
    ])
    smart_terms = _union([r.terms(r.both, s["specific_terms"]), r.terms(r.more, strong_terms), _if(bluetooth, "bluetooth"), _if(near, "smart_near_bulb"), r.terms(r.all, b["ecosystem_terms"])])
    none = F.array().cast("array<string>")
    return r.finish(decided, identity & smart & ~barred, [*b["identity_terms"], *s["specific_terms"]], r.terms(r.all, b["identity_terms"]), none, smart_terms, [*b["ecosystem_terms"], "bluetooth", "smart_near_bulb"])


def classify_switches(records: DataFrame, rules: Mapping) -> DataFrame:
    """The same for wall switches; rules: switch.{identity_terms, context_terms, protocol_terms, wrong_terms,
    accessory_terms, retrofit_phrases, rf_only_terms, radio_terms, dominant_terms, near_words}, smart.specific_terms."""
    w, s, r = rules["switch"], rules["smart"], _Recall(records)
    hit, title = r.hit, r.title
    near = within_tokens(title, ["smart"], list(w["near_words"]), 4)
    title_smart, aux_smart, protocol = hit(r.both, s["specific_terms"]), hit(r.more, s["specific_terms"]), hit(r.all, w["protocol_terms"])
    smart = title_smart | aux_smart | protocol | near
    identity = hit(title, w["identity_terms"]) | hit(r.categories, w["identity_terms"])
    context = hit(r.all, w["context_terms"])
    remote_only = hit(title, w["accessory_terms"]) & ~_any([F.contains(r.all, F.lit(p)) for p in w["retrofit_phrases"]])
    wrong, rf_only = hit(title, w["wrong_terms"]), hit(r.all, w["rf_only_terms"]) & ~(title_smart | aux_smart | hit(r.all, w["radio_terms"]))
    barred = "Primary identity is a prohibited switch type, accessory, or RF-only item."
    decided = _decided([
        (remote_only, "accessory", "exclude", "high", barred),
        (wrong, "wrong_device_type", "exclude", "high", barred),
        (rf_only, "non_smart", "exclude", "high", barred),
        (~identity, "insufficient_evidence", "exclude", "low", "Switch/dimmer identity is not explicit in title/categories."),
        (~context, "insufficient_evidence", F.when(smart, "hold").otherwise("exclude"), "low", "Metadata does not clearly establish wall-lighting control."),
        (~smart, "non_smart", "exclude", "medium", "Wall-lighting identity is present without approved connected-control evidence."),
        (r.multi & ~hit(title, w["dominant_terms"]), "ambiguous", "hold", "low", "Multiple device identities remain plausible."),
        (F.lit(True), "correct_target", "include", F.when(title_smart | protocol, "high").otherwise("medium"), "Primary switch identity, wall-lighting context, and connected-control evidence are all present."),
    ])
    smart_terms = _union([r.terms(r.both, s["specific_terms"]), r.terms(r.more, s["specific_terms"]), r.terms(r.all, w["protocol_terms"]), _if(near, "smart_near_switch")])
    support = [*w["identity_terms"], *w["context_terms"], *s["specific_terms"], *w["protocol_terms"]]
    return r.finish(decided, identity & context & smart & ~(remote_only | wrong | rf_only), support, r.terms(r.all, w["identity_terms"]), r.terms(r.all, w["context_terms"]), smart_terms, ["smart_near_switch"])


def gate_categories(reasons: Column, types: Column, device: str) -> Column:
    """The kinds of gate that kept a device type out, from its reasons."""
    own = F.filter(reasons, lambda r: r.startswith(f"{device}:"))
    rest = F.transform(own, lambda r: F.substring(r, F.lit(len(device) + 2), F.length(r)))
    named = F.transform(rest, lambda r: F.when(r.startswith("wrong_product:"), "wrong_product").otherwise(r))
    extra = F.array_compact(F.array(F.when(F.exists(reasons, lambda r: r.startswith("global:accessory")), "accessory"), F.when(F.size(types) > 1, "multi-type conflict")))
    return F.array_sort(F.array_distinct(F.concat(named, extra)))


def demote_conflicts(decisions: DataFrame, key: str, kind: str, decision: str) -> DataFrame:
    """Records included for several types are held for each of them."""
    several = decisions.where(F.col(decision) == "include").groupBy(key).agg(F.countDistinct(kind).alias("__n")).where("__n > 1").select(key, F.lit(True).alias("__conflict"))
    d = decisions.join(several, key, "left")
    return d.withColumn(decision, F.when(F.col("__conflict") & (F.col(decision) == "include"), "hold").otherwise(F.col(decision))).drop("__conflict")
