"""Transaction bundles as Spark jobs: explode, resolve references, stubs, chunks.

A bundle row is `(bundle_id, content)` with the JSON text of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import index_within
from ..functions.text import cascade, filled

BUNDLE = "struct<resourceType:string, type:string, entry:array<struct<fullUrl:string, resource:string>>>"
# Types uploaded first, in order.
FOUNDATION = ["Organization", "Practitioner", "PractitionerRole", "Location", "Patient"]
NPI_PREFIX = "Practitioner?identifier=http://hl7.org/fhir/sid/us-npi|"


def is_bundle_file(name: Column) -> Column:
    """Patient bundle by file name: no control, hospital or practitioner files."""
    skipped = name.rlike("^(_control/|hospitalInformation|practitionerInformation)") | (
        name == "device-associations.json"
    )
    return name.endswith(".json") & ~skipped


def explode_bundles(bundles: DataFrame) -> DataFrame:
    """One row per resource: position, full URL, type, id, canonical JSON text."""
    parsed = bundles.select("bundle_id", F.from_json("content", BUNDLE).alias("b"))
    entries = parsed.select("bundle_id", F.posexplode("b.entry").alias("pos", "e")).select(
        "bundle_id", "pos", F.col("e.fullUrl").alias("full_url"), F.col("e.resource").alias("resource")
    )
    return entries.select(
        "*", F.json_tuple("resource", "resourceType", "id").alias("resource_type", "resource_id")
    )


def full_url_map(entries: DataFrame) -> DataFrame:
    """`fullUrl -> Type/id` per bundle; the last entry wins on a repeated URL."""
    known = entries.where(
        filled(F.col("resource_type")).isNotNull()
        & filled(F.col("resource_id")).isNotNull()
        & filled(F.col("full_url")).isNotNull()
    )
    target = F.concat_ws("/", "resource_type", "resource_id")
    return known.groupBy("bundle_id", F.col("full_url").alias("ref")).agg(
        F.max_by(target, "pos").alias("direct_ref")
    )


def resource_uuid() -> Column:
    """Id used by direct references: URN tail, last URL segment, or own id."""
    url = F.col("full_url")
    return cascade(
        [
            (url.startswith("urn:uuid:"), F.replace(url, F.lit("urn:uuid:"), F.lit(""))),
            (url.contains("/"), F.element_at(F.split(url, "/"), -1)),
        ],
        F.col("resource_id"),
    )


def conditional_ref_map(entries: DataFrame) -> DataFrame:
    """`Type?identifier=system|value -> Type/uuid` for every identifier."""
    identifiers = F.from_json(
        F.get_json_object("resource", "$.identifier"), "array<struct<system:string, value:string>>"
    )
    rows = entries.select(
        "bundle_id", "pos", "resource_type", resource_uuid().alias("uuid"), F.inline(identifiers)
    ).where(
        filled(F.col("uuid")).isNotNull() & filled(F.col("system")).isNotNull() & filled(F.col("value")).isNotNull()
    )
    conditional = F.concat("resource_type", F.lit("?identifier="), "system", F.lit("|"), "value")
    return rows.groupBy("bundle_id", conditional.alias("ref")).agg(
        F.max_by(F.concat_ws("/", "resource_type", "uuid"), "pos").alias("direct_ref")
    )


#: A `reference` member's text in compact JSON. Quotes inside a text are escaped, so a bare quote
#: after a brace or comma opens a member name: text that merely looks like a member never matches.
#: It begins with the plain name, which the regex engine searches for without a step per character.
NAME = '"reference":"'
MEMBER = NAME + r'(?<=[{,]"reference":")((?:[^"\\]|\\.)*+)(?=")'


def _unescaped(text: Column) -> Column:
    parsed = F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v")
    return F.when(text.contains("\\"), parsed).otherwise(text)


def _escaped(text: Column) -> Column:
    # to_json of a one-element array gives the escaped text in brackets and quotes.
    quoted = F.to_json(F.array(text))
    return F.when(text.rlike(r'["\\\x00-\x1F]'), F.substring(quoted, F.lit(3), F.length(quoted) - 4)).otherwise(text)


def reference_list(resource: Column) -> Column:
    """Every `reference` text at any depth of compact JSON, unescaped."""
    return F.transform(F.regexp_extract_all(resource, F.lit(MEMBER), 1), _unescaped)


def _let(value: Column, then) -> Column:
    """`then(value)` with the value computed once per row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _last_upto(pairs: Column, ref: Column) -> Column:
    """Index of the last of the sorted pairs whose `ref` is not above the given one, by halving; -1 without."""
    digits = F.least(F.length(F.bin(F.size(pairs))), F.lit(25))
    steps = F.slice(F.array(*[F.lit(1 << b) for b in range(24, -1, -1)]), -digits, digits)
    return F.aggregate(
        steps, F.lit(-1), lambda p, b: F.when(F.coalesce(F.get(pairs, p + b)["ref"] <= ref, F.lit(False)), p + b).otherwise(p)
    )


def rewrite_references(resource: Column, pairs: Column) -> Column:
    """Struct of the resource with each reference that `pairs` (ref, pos, direct_ref) knows replaced, and how many distinct ones.

    The text is cut at its reference members and put together again, so each
    is replaced once and nothing else is touched. `pairs` is sorted; of equal
    references the one with the largest position counts.
    """
    raw = F.regexp_extract_all(resource, F.lit(MEMBER), 1)

    def target(text: Column) -> Column:
        def known(ref: Column) -> Column:
            return _let(F.get(pairs, _last_upto(pairs, ref)), lambda p: F.when(p["ref"] == ref, p["direct_ref"]))

        return F.struct(text.alias("raw"), _let(_unescaped(text), known).alias("direct"))

    def joined(found: Column) -> Column:
        def whole(pieces: Column) -> Column:
            rest = F.zip_with(found, F.slice(pieces, F.lit(2), F.size(found)), lambda f, piece: F.concat(F.lit(NAME), F.coalesce(_escaped(f["direct"]), f["raw"]), piece))
            return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

        return F.struct(
            F.when(F.size(found) > 0, _let(F.split(resource, MEMBER, -1), whole)).otherwise(resource).alias("resource"),
            F.size(F.array_distinct(F.filter(found, lambda f: f["direct"].isNotNull()))).alias("resolved"),
        )

    return _let(F.transform(raw, target), joined)


HEAD = "struct<resourceType:string, id:string, identifier:array<struct<system:string, value:string>>>"


def resolve_bundles(bundles: DataFrame) -> DataFrame:
    """Entries of (bundle_id, content) with URN and conditional references made direct; unknown ones stay.

    A bundle is one row, and so are its references: the map is an array sorted
    in the row, each reference is looked up by halving. One read, no shuffle.
    """
    parsed = bundles.select("bundle_id", F.from_json("content", BUNDLE)["entry"].alias("entry"))
    entry = F.transform(
        "entry",
        lambda e, i: F.struct(i.alias("pos"), e["fullUrl"].alias("full_url"), e["resource"].alias("resource"), F.from_json(e["resource"], HEAD).alias("head")),
    )

    def own(e: Column) -> Column:
        kind, rid, url = e["head"]["resourceType"], e["head"]["id"], e["full_url"]
        pair = lambda ref, target: F.struct(ref.alias("ref"), e["pos"].alias("pos"), target.alias("direct_ref"))
        direct = F.when(filled(kind).isNotNull() & filled(rid).isNotNull() & filled(url).isNotNull(), F.array(pair(url, F.concat(kind, F.lit("/"), rid))))
        uuid = cascade(
            [(url.startswith("urn:uuid:"), F.replace(url, F.lit("urn:uuid:"), F.lit(""))), (url.contains("/"), F.element_at(F.split(url, "/"), -1))], rid
        )
        usable = F.filter(
            e["head"]["identifier"],
            lambda x: filled(uuid).isNotNull() & filled(x["system"]).isNotNull() & filled(x["value"]).isNotNull() & kind.isNotNull(),
        )
        named = F.transform(usable, lambda x: pair(F.concat(kind, F.lit("?identifier="), x["system"], F.lit("|"), x["value"]), F.concat(kind, F.lit("/"), uuid)))
        none = F.array().cast("array<struct<ref:string,pos:int,direct_ref:string>>")
        return F.concat(F.coalesce(direct, none), F.coalesce(named, none))

    known = parsed.select("bundle_id", entry.alias("entry")).select("*", F.sort_array(F.flatten(F.transform("entry", own))).alias("pairs"))
    # outer, then without the empty row: a plain explode would have its input, the parsed bundle, computed in a filter too
    entries = known.select("bundle_id", "pairs", F.explode_outer("entry").alias("e")).where("e.pos is not null")
    return entries.select(
        "bundle_id", "e.pos", "e.full_url", "e.head.resourceType", "e.head.id", rewrite_references(F.col("e.resource"), F.col("pairs")).alias("new")
    ).select(
        "bundle_id", "pos", "full_url", F.col("resourceType").alias("resource_type"), F.col("id").alias("resource_id"), "new.resource", "new.resolved"
    )


def extract_references(entries: DataFrame) -> DataFrame:
    return entries.select(
        "bundle_id", "pos", "resource_type", "resource_id", F.explode(reference_list(F.col("resource"))).alias("ref")
    )


def resolve_references(entries: DataFrame) -> DataFrame:
    """`resolve_bundles` for entries that are rows already, such as those of a bundle too large for one.

    Distinct references join the maps on (bundle, reference), so the shuffle key
    is fine even for a huge bundle; each resource then gets its own small map.
    """
    maps = full_url_map(entries).unionByName(conditional_ref_map(entries))
    used = extract_references(entries).select("bundle_id", "pos", "ref").distinct()
    found = (
        used.join(maps, ["bundle_id", "ref"])
        .groupBy("bundle_id", "pos")
        .agg(F.sort_array(F.collect_list(F.struct("ref", F.lit(0).alias("pos"), "direct_ref"))).alias("pairs"))
    )
    return (
        entries.join(found, ["bundle_id", "pos"], "left")
        .withColumn("_new", F.when(F.col("pairs").isNotNull(), rewrite_references(F.col("resource"), F.col("pairs"))))
        .withColumn("resource", F.coalesce("_new.resource", "resource"))
        .withColumn("resolved", F.coalesce("_new.resolved", F.lit(0)))
        .drop("pairs", "_new")
    )


def flag_conditional_refs(entries: DataFrame) -> DataFrame:
    """Does a resource still hold a conditional reference?"""
    return entries.withColumn(
        "has_conditional_ref",
        F.coalesce(F.exists(reference_list(F.col("resource")), lambda r: r.contains("?")), F.lit(False)),
    )


def md5_uuid(text: Column) -> Column:
    h = F.md5(text)
    cut = lambda start, n: F.substring(h, start, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def stub_missing_resources(
    entries: DataFrame, sites: DataFrame, known_locations: DataFrame | None = None
) -> DataFrame:
    """Minimal practitioner, location and organisation rows for unresolved references.

    `sites` `(site_index, name, city, state, latitude, longitude)` is a small
    dimension; a location takes the site at its id hash modulo the site count.
    """
    refs = extract_references(entries).where(F.col("ref").contains("?")).select("ref").distinct()
    people = refs.where(F.startswith("ref", F.lit(NPI_PREFIX)))
    npi = F.element_at(F.split("ref", r"\|"), -1)
    practitioners = people.select(
        "ref",
        F.lit("Practitioner").alias("resource_type"),
        md5_uuid(F.concat(F.lit("practitioner-npi-"), npi)).alias("resource_id"),
        F.concat(F.lit("Provider-"), F.right(npi, F.lit(4))).alias("name"),
    )
    # System and value of `Type?identifier=system|value`; other forms give no stub.
    query = F.try_url_decode(F.regexp_extract("ref", r"\?(?:.*&)?identifier=([^&]*)", 1))
    parts = refs.where(query.contains("|")).select(
        "ref",
        F.substring_index("ref", "?", 1).alias("kind"),
        F.substring_index(query, "|", 1).alias("system"),
        F.regexp_extract(query, r"^[^|]*\|(.*)$", 1).alias("value"),
    )
    identity = lambda word: F.concat(F.lit(f"{word}-"), "system", F.lit("-"), "value")
    organizations = parts.where(F.col("kind") == "Organization").select(
        "ref",
        F.col("kind").alias("resource_type"),
        md5_uuid(identity("organization")).alias("resource_id"),
        F.concat(
            F.lit("Organization "), F.when(F.length("value") > 8, F.right("value", F.lit(8))).otherwise(F.col("value"))
        ).alias("name"),
    )
    wanted = parts.where(F.col("kind") == "Location")
    if known_locations is not None:
        wanted = wanted.join(known_locations.select("ref"), "ref", "left_anti")
    count = sites.agg(F.count("*").alias("_n"))
    slot = F.conv(F.substring(F.col("resource_id"), 1, 8), 16, 10).cast("bigint")
    locations = (
        wanted.select("ref", F.lit("Location").alias("resource_type"), md5_uuid(identity("location")).alias("resource_id"))
        .crossJoin(F.broadcast(count))
        .withColumn("site_index", F.pmod(slot, F.col("_n")))
        .join(sites, "site_index")
        .select("ref", "resource_type", "resource_id", "name", "city", "state", "latitude", "longitude")
    )
    return (
        locations.unionByName(practitioners, allowMissingColumns=True)
        .unionByName(organizations, allowMissingColumns=True)
    )


def order_and_chunk_entries(entries: DataFrame, max_entries: int = 400) -> DataFrame:
    """Chunk number and upload order per bundle.

    A bundle within the limit stays whole and in its own order. A larger one
    sends all foundational types first; the rest fills the first chunk and then
    further chunks of `max - foundational` entries.
    """
    kind = F.col("resource_type")
    order = cascade([(kind == t, i) for i, t in enumerate(FOUNDATION)], 99)
    ranked = entries.withColumn("type_rank", order)
    sizes = ranked.groupBy("bundle_id").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("type_rank") < 99, 1)).alias("foundational")
    )
    others = index_within(
        ranked.where("type_rank = 99").select("bundle_id", "pos"), "bundle_id", "pos", "other_index"
    )
    step = F.greatest(F.lit(max_entries) - F.col("foundational"), F.lit(1))
    return (
        ranked.join(sizes, "bundle_id")
        .join(others, ["bundle_id", "pos"], "left")
        .withColumn(
            "chunk",
            F.when((F.col("total") <= max_entries) | (F.col("type_rank") < 99), F.lit(0)).otherwise(
                F.floor(F.col("other_index") / step)
            ).cast("int"),
        )
        .withColumn("type_rank", F.when(F.col("total") <= max_entries, F.lit(0)).otherwise(F.col("type_rank")))
        .drop("total", "foundational", "other_index")
    )


def qualifying_cohort(conditions: DataFrame, snomed: list[str], icd_prefixes: list[str]) -> DataFrame:
    """Patients with an exact SNOMED code or an ICD prefix (also without system)."""
    system = F.lower(F.coalesce("c.system", F.lit("")))
    code = F.coalesce("c.code", F.lit(""))
    prefix = code.rlike("^(" + "|".join(p.replace(".", r"\.") for p in icd_prefixes) + ")")
    hit = (system.contains("snomed") & code.isin(snomed)) | ((system.contains("icd") | (system == "")) & prefix)
    return conditions.select("patient_id", F.explode("codings").alias("c")).where(hit).select("patient_id").distinct()


def site_membership(entries: DataFrame, site_ids: list[str]) -> DataFrame:
    """Is the provider of the bundle's first encounter one of the given sites?"""
    provider = F.get_json_object("resource", "$.serviceProvider.reference")
    first = (
        entries.where(F.col("resource_type") == "Encounter")
        .select("bundle_id", "pos", provider.alias("provider"))
        .where(filled(F.col("provider")).isNotNull())
        .groupBy("bundle_id")
        .agg(F.min_by("provider", "pos").alias("provider"))
    )
    org = F.lower(F.element_at(F.split("provider", "/"), -1))
    member = F.exists(F.array(*[F.lit(s) for s in site_ids]), lambda s: org.contains(s))
    return first.select("bundle_id", org.alias("provider_org"), member.alias("is_member"))


def bundle_batches(resources: DataFrame, key: str, batch_size: int = 200) -> DataFrame:
    """Batch number of each resource in key order; batches of one size."""
    from ..functions.ranking import sorted_index

    if not 1 <= batch_size <= 400:
        raise ValueError("batch size must be between 1 and 400")
    return sorted_index(resources, key, "_i").withColumn(
        "batch", F.floor(F.col("_i") / batch_size).cast("int")
    ).drop("_i")
