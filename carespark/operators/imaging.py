"""Imaging: collection choice, body site, study rows, manifests, re-tagged metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import any_of, cascade, filled

# Condition code -> modality and collection, in match order.
MODALITY_MAP = [
    ("13645005", "CT", "LIDC-IDRI"),
    ("195967001", "CR", "RSNA Pneumonia"),
    ("233604007", "CR", "RSNA Pneumonia"),
    ("84114007", "CT", "LIDC-IDRI"),
    ("840539006", "CT", "LIDC-IDRI"),
    ("59621000", "CT", "LIDC-IDRI"),
    ("44054006", "CR", "RSNA Pneumonia"),
    ("53741008", "CT", "LIDC-IDRI"),
    ("22298006", "CT", "LIDC-IDRI"),
    ("162864005", "CT", "LIDC-IDRI"),
]
DEFAULT_IMAGING = ("CT", "LIDC-IDRI")
# Words -> code, display, text, body part; first match wins.
BODY_SITES = [
    (["copd", "asthma", "pneumonia", "respiratory", "covid", "lung", "heart", "coronary", "myocardial", "hypertension"], ("39607008", "Chest", "Chest", "CHEST")),
    (["sleep", "insomnia", "migraine", "headache", "stroke", "neuro", "seizure", "head"], ("69536005", "Head structure", "Head", "HEAD")),
    (["diabetes", "obesity", "abdominal", "gastro", "liver", "kidney", "renal", "pancrea"], ("113345001", "Abdominal structure", "Abdomen", "ABDOMEN")),
]
DEFAULT_SITE = ("39607008", "Chest", "Chest", "CHEST")


def assign_collection(patients: DataFrame, conditions: DataFrame) -> DataFrame:
    """First matching map row per patient, the default where none matches."""
    mapping = patients.sparkSession.createDataFrame(
        [(c, i, m, col) for i, (c, m, col) in enumerate(MODALITY_MAP)],
        "code string, rank int, modality string, collection string",
    )
    snomed = F.lower("system").contains("snomed")
    best = (
        conditions.where(snomed & F.col("code").isin([m[0] for m in MODALITY_MAP]))
        .select("patient_id", "code")
        .join(F.broadcast(mapping.select("code", "rank")), "code")
        .groupBy("patient_id")
        .agg(F.min("rank").alias("rank"))
        .join(F.broadcast(mapping.drop("code")), "rank")
        .select("patient_id", "modality", "collection")
    )
    return patients.select("patient_id").join(best, "patient_id", "left").fillna(
        {"modality": DEFAULT_IMAGING[0], "collection": DEFAULT_IMAGING[1]}
    )


def body_site(text: Column) -> Column:
    site = lambda v: F.struct(
        F.lit(v[0]).alias("code"), F.lit(v[1]).alias("display"), F.lit(v[2]).alias("text"), F.lit(v[3]).alias("body_part")
    )
    return cascade([(any_of(text, words), site(v)) for words, v in BODY_SITES], site(DEFAULT_SITE))


def infer_body_site(patients: DataFrame, conditions: DataFrame) -> DataFrame:
    """Body site from the words of a patient's SNOMED diagnoses.

    Word groups are tested per row and combined by maximum, so no condition
    list is ever collected.
    """
    flags = (
        conditions.where(F.lower("system").contains("snomed"))
        .groupBy("patient_id")
        .agg(*[F.max(any_of(F.col("display"), words)).alias(f"g{i}") for i, (words, _) in enumerate(BODY_SITES)])
    )
    pick = lambda j: cascade([(F.col(f"g{i}"), v[j]) for i, (_, v) in enumerate(BODY_SITES)], DEFAULT_SITE[j])
    names = ["body_site_code", "body_site_display", "body_site_text", "body_part"]
    return (
        patients.select("patient_id").join(flags, "patient_id", "left")
        .select("patient_id", *[pick(j).alias(n) for j, n in enumerate(names)])
    )


def imaging_study_rows(studies: DataFrame, base_path: str) -> DataFrame:
    """Study resources as JSON text, one series each.

    Input `(patient_id, study_uid, series_uid, modality, body_site_code,
    body_site_display, instance_count, started)`.
    """
    folder = F.concat(F.lit(base_path.rstrip("/") + "/"), "patient_id", F.lit("/"), "study_uid")
    n = F.col("instance_count")
    resource = F.struct(
        F.lit("ImagingStudy").alias("resourceType"),
        F.lit("available").alias("status"),
        F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference")).alias("subject"),
        F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started"),
        F.lit(1).alias("numberOfSeries"),
        n.alias("numberOfInstances"),
        F.concat(n.cast("string"), F.lit(" re-tagged instances")).alias("description"),
        F.array(
            F.struct(
                F.col("series_uid").alias("uid"),
                F.struct(
                    F.lit("http://dicom.nema.org/resources/ontology/DCM").alias("system"),
                    F.col("modality").alias("code"),
                ).alias("modality"),
                n.alias("numberOfInstances"),
                F.struct(
                    F.lit("http://snomed.info/sct").alias("system"),
                    F.col("body_site_code").alias("code"),
                    F.col("body_site_display").alias("display"),
                ).alias("bodySite"),
            )
        ).alias("series"),
        F.array(
            F.struct(
                F.lit("urn:dicom:uid").alias("system"), F.concat(F.lit("urn:oid:"), "study_uid").alias("value")
            )
        ).alias("identifier"),
        F.array(F.struct(F.concat(F.lit("DICOM files stored at: "), folder).alias("text"))).alias("note"),
    )
    return studies.select("patient_id", "study_uid", F.to_json(resource).alias("resource"))


def imaging_manifest(studies: DataFrame, metadata: DataFrame) -> DataFrame:
    """Study manifest: actual values over planned ones, bare study uid.

    `studies` hold the plan, `metadata` one row per study with the tags found.
    """
    bare = F.regexp_replace("study_uid", "^urn:oid:", "")
    over = lambda actual, planned: F.coalesce(filled(F.col(actual)), F.col(planned))
    return studies.join(metadata, "study_uid", "left").select(
        "patient_id",
        over("tag_patient_id", "patient_id").alias("dicom_patient_id"),
        "device_id",
        bare.alias("study_instance_uid"),
        F.concat(F.lit("urn:oid:"), bare).alias("study_instance_uid_urn"),
        "series_uid",
        "planned_modality",
        over("tag_modality", "planned_modality").alias("actual_modality"),
        over("tag_body_part", "body_part").alias("body_part_examined"),
        "body_site_code",
        "body_site_display",
        "tag_study_date",
        "instance_count",
        "collection",
    )


def dicom_uid(*parts) -> Column:
    """Stable numeric uid under the uuid root, from a hash of its parts."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat(
        F.lit("2.25."),
        F.conv(F.substring(digest, 1, 15), 16, 10),
        F.lpad(F.conv(F.substring(digest, 16, 12), 16, 10), 15, "0"),
    )


def retag_metadata(instances: DataFrame, patients: DataFrame, device_of: DataFrame, institution: str) -> DataFrame:
    """New patient, study and series fields over instance metadata rows.

    Study and series uids are shared inside their study and series, instance
    uids are unique; pixel files are not touched. Instances
    `(patient_id, source_study, source_series, instance_number, modality, body_part, study_date)`.
    """
    sex = cascade([(F.lower("gender") == "male", "M"), (F.lower("gender") == "female", "F")], "O")
    who = patients.select(
        "patient_id",
        F.concat_ws("^", "family", "given").alias("tag_patient_name"),
        F.coalesce(F.date_format("birth_date", "yyyyMMdd"), F.lit("")).alias("tag_birth_date"),
        sex.alias("tag_sex"),
    )
    return (
        instances.join(who, "patient_id")
        .join(device_of.select("patient_id", "device_id"), "patient_id", "left")
        .select(
            "patient_id",
            "tag_patient_name",
            "tag_birth_date",
            "tag_sex",
            dicom_uid("patient_id", "source_study").alias("study_uid"),
            dicom_uid("patient_id", "source_study", "source_series").alias("series_uid"),
            dicom_uid("patient_id", "source_study", "source_series", F.col("instance_number").cast("string")).alias("sop_uid"),
            F.concat(F.lit("ACC-"), F.coalesce("device_id", F.lit("NONE"))).alias("accession_number"),
            F.lit(institution).alias("institution_name"),
            F.date_format("study_date", "yyyyMMdd").alias("study_date"),
            "body_part",
            "modality",
        )
    )
