"""Typed healthcare views derived from the given tables.

Each view is one list of column expressions over one or two base tables,
written so that Spark SQL and the checking SQL read the same text; `div` and
date addition are the only spelled-out differences.
"""

from __future__ import annotations


# Declared schemas of the given tables: no footer-reading job per query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def pick(key: str, values: list) -> str:
    """Literal chosen by `key % len(values)`."""
    quote = lambda v: "null" if v is None else f"'{v}'"
    arms = " ".join(f"when {i} then {quote(v)}" for i, v in enumerate(values))
    return f"(case ({key}) % {len(values)} {arms} end)"


class Dialect:
    def __init__(self, name: str):
        self.spark = name == "spark"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def plus_days(self, day: str, n: str) -> str:
        if self.spark:
            return f"date_add(date '{day}', cast({n} as int))"
        return f"cast(date '{day}' + cast({n} as integer) as date)"

    def ts_plus_hours(self, ts: str, hours: str) -> str:
        if self.spark:
            return f"({ts} + make_dt_interval(0, cast({hours} as int), 0, 0))"
        return f"({ts} + to_hours(cast({hours} as integer)))"


CONDITION_CODES = [
    ("http://snomed.info/sct", "44054006", "Diabetes mellitus type 2"),
    ("http://snomed.info/sct", "59621000", "Essential hypertension"),
    ("http://snomed.info/sct", "84114007", "Heart failure"),
    ("http://snomed.info/sct", "13645005", "Chronic obstructive lung disease (COPD)"),
    ("http://snomed.info/sct", "195967001", "Asthma"),
    ("http://snomed.info/sct", "233604007", "Pneumonia"),
    ("http://hl7.org/fhir/sid/icd-10-cm", "E11.9", "Diabetes without complications"),
    ("http://snomed.info/sct", "73211009", "Diabetes mellitus"),
    ("http://hl7.org/fhir/sid/icd-10-cm", "I50.9", "Congestive heart failure"),
    ("http://snomed.info/sct", "431855005", "Chronic kidney disease stage 4"),
    ("http://snomed.info/sct", "444814009", "Viral sinusitis"),
    ("http://snomed.info/sct", "36923009", "Major depression"),
    ("http://snomed.info/sct", "42343007", "Congestive heart failure"),
    ("http://hl7.org/fhir/sid/icd-10-cm", "J44.1", "COPD with exacerbation"),
    ("http://snomed.info/sct", "162864005", "Obesity"),
    ("http://snomed.info/sct", "195662009", "Acute viral pharyngitis"),
    ("", "E11.65", "Diabetes with hyperglycemia"),
]
LOINC = ["4548-4", "8480-6", "8462-4", "39156-5", "14959-1", "2708-6", "8867-4"]
LOINC_NAMES = ["Hemoglobin A1c", "Systolic blood pressure", "Diastolic blood pressure", "Body mass index", "Urine albumin/creatinine", "Oxygen saturation", "Heart rate"]
DRUGS = ["lisinopril 10 MG", "metformin 500 MG", "Atorvastatin 20 MG", "metoprolol 25 MG", "carvedilol 6.25 MG", "Losartan 50 MG", "insulin glargine", "simvastatin 40 MG", "albuterol inhaler", "amoxicillin 250 MG", "glipizide 5 MG", "rosuvastatin 10 MG"]
CVX = ["33", "109", "133", "140", "150", "158", "208", "115"]
OTHER_CVX = "21"  # in no measure
PROCEDURES = ["99213", "99214", "99215", "99281", "99283", "99285", "71046", "80053", "93000", "36415", "99284"]
CLAIM_TYPES = ["Professional", "Institutional", "Emergency", "Pharmacy", "Outpatient"]
PAYORS = {  # market segment -> (code, display, text, payor)
    "AUTOMOBILE": ("MCPOL", "Medicare policy", "Part B", "CMS"),
    "BUILDING": ("MCD", "public plan", "state plan", "State Plan"),
    "FURNITURE": ("EHCPOL", "employer plan", "group", "Blue Cross"),
    "HOUSEHOLD": ("PAY", "Self-pay", "none", "Self"),
    "MACHINERY": ("OTH", "other", "other", "Acme"),
}
LINE_KEY = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"


def views(engine: str) -> dict[str, tuple[str, str | None, list[tuple[str, str]]]]:
    """name -> (base tables, filter, columns)."""
    q = Dialect(engine)
    k = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
    seg = lambda i: "(case c_mktsegment " + " ".join(
        f"when '{s}' then '{v[i]}'" for s, v in PAYORS.items()
    ) + " end)"
    line = "lineitem join orders on l_orderkey = o_orderkey"
    flags = (
        "(case when l_orderkey % 200 = 0 then 'amount_outlier|denial_pattern|upcoding' "
        "when l_orderkey % 40 = 0 then 'amount_outlier|denial_pattern' "
        "when l_orderkey % 100 = 0 then 'amount_outlier|upcoding' "
        "when l_orderkey % 20 = 0 then 'amount_outlier' "
        "when l_orderkey % 25 = 0 then 'upcoding' else '' end)"
    )
    amount = "cast(l_extendedprice as decimal(18,2))"
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    pct = "cast(round(l_discount * 100) as int)"
    paid_cents = q.idiv(f"{cents} * (100 - {pct})", "100")
    paid = f"cast({paid_cents} * 0.01 as decimal(18,2))"
    obs_value = (
        f"cast(case l_partkey % {len(LOINC)} "
        "when 0 then 4 + cast(l_quantity as int) * 0.15 "
        "when 1 then 90 + cast(l_quantity as int) * 1.50 "
        "when 2 then 50 + cast(l_quantity as int) * 1.00 "
        "when 3 then 18 + cast(l_quantity as int) * 0.40 "
        "else cast(l_quantity as int) * 1.00 end as decimal(10,2))"
    )
    drug = "o_custkey + (case when o_orderkey % 5 = 0 then 1 else 0 end)"
    cond = "o_orderkey"
    day = q.plus_days
    return {
        "telemetry": (
            "events", None,
            [
                ("event_id", "event_id"),
                ("device_id", "concat('DEV-', lpad(cast(user_id as string), 5, '0'))"),
                ("ts", "ts"),
                ("spo2", "cast(greatest(99 - cast(value as decimal(10,2)) * 0.04, 70.0) as decimal(8,4))"),
                ("pr", f"cast(60 + {q.idiv(k, '2')} + (case when event_type = 'error' and value > 100 then 50 "
                       "when event_type = 'signup' and value > 100 then -25 else 0 end) as int)"),
                ("pi", f"cast(1 + {k} * 0.04 as decimal(8,2))"),
                ("pvi", f"cast(5 + {k} % 25 as int)"),
                ("sphb", "cast(11.5 + (event_id % 21) * 0.1 as decimal(8,1))"),
                ("signal_iq", "cast(90 + event_id % 11 as int)"),
            ],
        ),
        "claims": (
            line, None,
            [
                ("event_id", f"concat('EVT-', {LINE_KEY})"),
                ("event_timestamp", "l_shipdate"),
                ("event_type", "'CLAIM_SUBMITTED'"),
                ("claim_id", f"concat('CLM-', {LINE_KEY})"),
                ("patient_id", "concat('pat-', o_custkey)"),
                ("provider_id", "concat('prov-', l_suppkey)"),
                ("facility_id", "concat('loc-', l_suppkey % 11)"),
                ("payer_id", "concat('cov-', o_custkey)"),
                ("diagnosis_code", pick("l_partkey", [c for _, c, _ in CONDITION_CODES[:7]])),
                ("procedure_code", pick("l_partkey", PROCEDURES)),
                ("claim_type", pick("l_partkey", CLAIM_TYPES)),
                ("claim_amount", amount),
                ("latitude", "cast(33 + (l_suppkey % 100) * 0.01 as double)"),
                ("longitude", "cast(-84 - (l_suppkey % 100) * 0.01 as double)"),
                ("injected_fraud_flags", flags),
            ],
        ),
        "eob": (
            line, None,
            [
                ("num", "l_orderkey"),
                ("claim_id", f"concat('CLM-', {LINE_KEY})"),
                ("patient_id", "concat('pat-', o_custkey)"),
                ("provider_id", "concat('prov-', l_suppkey)"),
                ("facility_id", "concat('loc-', l_suppkey % 11)"),
                ("coverage_id", "(case when l_orderkey % 3 = 0 then '' else concat('cov-', o_custkey) end)"),
                ("claim_type", pick("l_partkey", CLAIM_TYPES)),
                ("outcome", f"(case when {flags} <> '' then 'partial' when l_orderkey % 17 = 0 then null else 'complete' end)"),
                ("bill_start", "(case when l_orderkey % 29 = 0 then null else cast(l_shipdate as date) end)"),
                ("created", "cast(o_orderdate as date)"),
                ("billed", amount),
                ("paid", paid),
                ("payment", f"(case when l_partkey % 13 = 0 then null else {paid} end)"),
            ],
        ),
        "patients": (
            "customer", None,
            [
                ("num", "c_custkey"),
                ("patient_id", "concat('pat-', c_custkey)"),
                ("birth_date", day("2026-07-01", "-((1 + c_custkey % 95) * 365 + c_custkey % 365)")),
                ("gender", "(case when c_custkey % 2 = 0 then 'male' else 'female' end)"),
                ("given", "concat('Given', c_custkey)"),
                ("family", "concat('Family', c_nationkey)"),
                ("site", "concat('loc-', c_nationkey % 11)"),
            ],
        ),
        "coverage": (  # some patients have none: the next one holds two
            "customer", None,
            [
                ("num", "c_custkey"),
                ("coverage_id", "concat('cov-', c_custkey)"),
                ("patient_id", "concat('pat-', c_custkey + (case when c_custkey % 10 = 3 then 1 else 0 end))"),
                ("type_code", seg(0)),
                ("type_display", seg(1)),
                ("type_text", seg(2)),
                ("payer_name", seg(3)),
                ("cov_start", f"(case when c_custkey % 23 = 0 then null else {day('2022-01-01', '(c_custkey % 36) * 30')} end)"),
                ("cov_end", f"(case when c_custkey % 5 = 0 then {day('2025-12-31', 'c_custkey % 180')} else null end)"),
            ],
        ),
        "coverage2": (  # held by every fourth patient
            "customer", None,
            [
                ("num", "c_custkey"),
                ("coverage_id", "concat('covb-', c_custkey)"),
                ("patient_id", "concat('pat-', c_custkey - c_custkey % 4)"),
                ("type_code", "'EHCPOL'"),
                ("type_display", "'private plan'"),
                ("type_text", "'ppo'"),
                ("payer_name", "'Aetna PPO'"),
                ("cov_start", day("2021-06-02", "(c_custkey % 48) * 30")),
                ("cov_end", day("2026-03-01", "c_custkey % 100")),
            ],
        ),
        "conditions": (
            "orders", None,
            [
                ("num", "o_orderkey"),
                ("condition_id", "concat('cond-', o_orderkey)"),
                ("patient_id", "concat('pat-', o_custkey)"),
                ("encounter_id", "concat('enc-', o_orderkey)"),
                ("system", pick(cond, [s for s, _, _ in CONDITION_CODES])),
                ("code", pick(cond, [c for _, c, _ in CONDITION_CODES])),
                ("display", pick(cond, [d for _, _, d in CONDITION_CODES])),
                ("clinical_status", "(case when o_orderkey % 7 = 0 then 'resolved' when o_orderkey % 11 = 0 then null "
                                    "when o_orderkey % 13 = 0 then 'recurrence' else 'active' end)"),
                ("onset_date", "cast(o_orderdate as date)"),
            ],
        ),
        "observations": (
            line, None,
            [
                ("num", "l_orderkey"),
                ("observation_id", f"concat('obs-', {LINE_KEY})"),
                ("patient_id", "concat('pat-', o_custkey)"),
                ("code", pick("l_partkey", LOINC)),
                ("display", pick("l_partkey", LOINC_NAMES)),
                ("value", obs_value),
                ("unit", pick("l_partkey", ["%", "mm[Hg]", "mm[Hg]", "kg/m2", "mg/g", "%", "/min"])),
                ("obs_date", day("2025-06-20", "l_orderkey % 400")),
            ],
        ),
        "medications": (
            "orders", None,
            [
                ("num", "o_orderkey"),
                ("medication_id", "concat('med-', o_orderkey)"),
                ("patient_id", "concat('pat-', o_custkey)"),
                ("code", "concat('rx', " + f"({drug}) % {len(DRUGS)})"),
                ("display", pick(drug, DRUGS)),
                ("authored_date", day("2025-06-20", "(o_orderkey * 31) % 385")),
                ("status", "(case when o_orderkey % 9 = 0 then 'stopped' else 'active' end)"),
            ],
        ),
        "immunizations": (
            "orders", None,
            [
                ("num", "o_orderkey"),
                ("immunization_id", "concat('imm-', o_orderkey)"),
                ("patient_id", "concat('pat-', o_custkey)"),
                ("code", f"(case when o_orderkey % 3 = 0 then {pick('o_orderkey', CVX)} else '{OTHER_CVX}' end)"),
                ("display", f"concat('Vaccine ', case when o_orderkey % 3 = 0 then {pick('o_orderkey', CVX)} else '{OTHER_CVX}' end)"),
                ("imm_date", day("2025-06-20", "o_orderkey % 400")),
            ],
        ),
        "encounters": (
            "orders", None,
            [
                ("num", "o_orderkey"),
                ("encounter_id", "concat('enc-', o_orderkey)"),
                ("patient_id", "concat('pat-', o_custkey)"),
                ("encounter_class", "(case o_orderpriority when '1-URGENT' then 'emergency' when '2-HIGH' then 'IMP' "
                                    "when '3-MEDIUM' then 'AMB' when '4-NOT SPECIFIED' then 'EMER' else 'inpatient' end)"),
                ("type_display", pick("o_orderkey", ["Hospital admission", "Office visit", "Emergency room visit", "Well child visit", "Inpatient stay", "Follow-up", "Telephone"])),
                ("start_time", "o_orderdate"),
                ("end_time", f"(case when o_orderkey % 50 = 0 then null else {q.ts_plus_hours('o_orderdate', '(o_orderkey % 9) * 24 + o_orderkey % 5')} end)"),
                ("location_id", "concat('loc-', o_orderkey % 29)"),  # some are unknown
                ("provider_org", pick("o_orderkey", ["org-main", "org-peds", "org-east"])),
            ],
        ),
        "locations": (
            "nation", None,
            [
                ("location_id", "concat('loc-', n_nationkey)"),
                ("id_orig", "(case when n_nationkey % 3 = 0 then concat('orig-', n_nationkey) else concat('loc-', n_nationkey) end)"),
                ("name", "concat('Hospital ', n_name)"),
                ("latitude", "(case when n_nationkey = 7 then null else cast(33 + n_nationkey * 0.1 as double) end)"),
                ("longitude", "(case when n_nationkey = 7 then null else cast(-84 - n_nationkey * 0.1 as double) end)"),
                ("city", "concat('City ', n_regionkey)"),
                ("state", pick("n_regionkey", ["GA", "TN", "AL", "FL", "SC"])),
            ],
        ),
        "imaging": (
            "orders", None,
            [
                ("num", "o_orderkey"),
                ("study_id", "concat('img-', o_orderkey)"),
                ("patient_id", "concat('pat-', o_custkey)"),
                ("modality", pick(q.idiv("o_orderkey", "20"), ["CT", "CR", "MR", "CT"])),
                ("description", "concat('Study ', o_orderkey)"),
                ("started", "o_orderdate"),
                ("number_of_series", f"cast({q.idiv('o_orderkey', '20')} % 5 + 1 as int)"),
                ("number_of_instances", f"cast(({q.idiv('o_orderkey', '20')} % 5 + 1) * ({q.idiv('o_orderkey', '20')} % 4) as int)"),
            ],
        ),
    }


def duck_view(name: str) -> str:
    base, where, cols = views("duck")[name]
    sel = ", ".join(f"{e} as {n}" for n, e in cols)
    return f"select {sel} from {base}" + (f" where {where}" if where else "")
