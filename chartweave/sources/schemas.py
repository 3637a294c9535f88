"""Declared schemas: of clinical tables and of extraction payloads, and what a payload must hold. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = "id string, patient_id string, record_id string, source_document_id string, verification_status string, created_on date"
#: Columns that operators need, by table, as DDL.
TABLES = {
    "patients": "id string, user_id string, full_name string, blood_group string, allergies string, manual_condition string",
    "documents": "id string, patient_id string, sha256_hash string, is_deleted boolean, file_name string, category string, document_type string, processing_status string, hospital string, doctor string, created_on date",
    "labs": FACT + ", test_name string, value string, unit string, abnormal_flag boolean, test_date date",
    "medications": FACT + ", medicine_name string, strength string, dosage string, duration string, frequency string, start_date date, end_date date",
    "diagnoses": FACT + ", name string, is_chronic boolean, notes string",
    "procedures": FACT + ", name string, done_on date, notes string",
    "records": "record_id string, event_date date",
    "sessions": "session_id string, patient_id string, reason_category string, problem_location string, description string",
    "triage": "session_id long, patient_id string, reason_category string, onset string, severity string, symptoms string, language string",
    "requests": "event_id long, user_id string, action string, ts timestamp_ntz",
    "jobs": "id long, document_id string, status string, ts timestamp_ntz",
    "reviews": "id long, record_id string, field_name string, action string, ts timestamp_ntz",
    "versions": "document_id string, event_id long, ts timestamp_ntz",
    "tokens": "id long, expires_at timestamp_ntz, revoked_at timestamp_ntz",
    "config": "patient_id string, show_full_name boolean, show_blood_group boolean",
    "chunks": "document_id long, chunk_text string, patient_id string",
    "pages": "document_id string, patient_id string, file_name string, page_number int, text string",
    "questions": "question_id long, patient_id string, question string",
    "asked": "question_id long, patient_id string, question string",
    "reports": "document_id string, text string",
    "notes": "document_id string, text string",
    "letters": "document_id string, patient_id string, category string, text string",
    "uploads": "id long, content_hex string",
    "words": "document_id string, page long, block int, word_no long, text string, x long, y long, w int, h int, confidence double",
    "regions": "document_id string, region_id string, x long, y long, confidence double, file_name string",
    "payloads": "document_id long, payload string",
    "full_payloads": "document_id long, patient_id string, payload string",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, path: str, name: str, form: str = "parquet", **options: str) -> DataFrame:
    """The clinical table ``name`` at ``path`` by its declared schema; columns that the files lack are null, others are not read."""
    return spark.read.format(form).options(**options).schema(schema_of(name)).load(path)


def conforming(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of ``df``, cast to their types; a missing one is an error."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(name)))


SIMPLE = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _fields(**kinds: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField(n, k if isinstance(k, T.DataType) else SIMPLE[k]) for n, k in kinds.items()])


VALUE = _fields(value="string", confidence="double", sourceText="string", page="int")
VALUES = T.ArrayType(VALUE)


def _each(names: str, kind: T.DataType | str) -> dict[str, T.DataType | str]:
    return dict.fromkeys(names.split(), kind)


_source = {"confidence": "double", "sourceText": "string", "page": "int"}
#: The whole payload; keys that it doesn't name are not read.
PAYLOAD = _fields(
    documentType="string", classificationConfidence="double", classificationSource="string",
    **_each("documentTitle documentDate hospitalName doctorName doctorSpecialization patientNameOnDocument patientAgeOnDocument", VALUE),
    patientDetails=_fields(**_each("patientNameOnDocument age gender patientIdOrMrn", VALUE)),
    encounterDetails=_fields(**_each("hospitalName clinicName doctorName doctorSpecialization admissionDate dischargeDate visitDate", VALUE)),
    clinicalInformation=_fields(
        **_each("chiefComplaints presentingSymptoms provisionalDiagnoses finalDiagnoses comorbidities", VALUES),
        **_each("historyOfPresentIllness pastMedicalHistory familyHistory", VALUE),
    ),
    examination=_fields(vitals=_fields(**_each("bp hr temp rr spo2", VALUE)), **_each("generalExamination systemicExamination clinicalFindings", VALUE)),
    investigations=_fields(testsOrdered=VALUES, imaging=T.ArrayType(_fields(**_each("studyName findings impression", "string"), **_source)), investigationFindings=VALUE),
    treatment=_fields(surgeries=VALUES, **_each("treatmentGiven hospitalCourse", VALUE)),
    dischargePlan=_fields(**_each("dietaryAdvice activityAdvice nextVisit", VALUE), **_each("warningSigns referrals", VALUES)),
    diagnoses=T.ArrayType(_fields(name="string", onsetWeeks="double", isChronic="boolean", notes="string", **_source)),
    medications=T.ArrayType(_fields(**_each("medicineName genericName strength dosage route frequency duration instructions startDate endDate reason batch expiry quantity", "string"), **_source)),
    labResults=T.ArrayType(_fields(
        **_each("testName value unit referenceRange date rawValue rawUnit normalizedValue normalizedUnit normalizationStatus", "string"), abnormalFlag="boolean", **_source,
    )),
    procedures=T.ArrayType(_fields(**_each("name date surgeonName notes", "string"), **_source)),
    **_each("allergies notes certificatesOrRecommendations", VALUES),
    unreadableSections=T.ArrayType(_fields(description="string", page="int")),
    unmappedDocumentedInformation=T.ArrayType(_fields(**_each("text sectionHeading", "string"), **_source)),
    coverageMetrics=_fields(**_each("totalReadableTextBlocks mappedStructuredBlocks unmappedBlocks unreadableBlocks", "double")),
)
#: The types that a payload may have.
DOCUMENT_TYPES = [
    "Auto Detect", "Prescription", "Lab Report", "Discharge Summary", "Imaging Report", "Medical Certificate", "Vaccination Record", "Other", "PRESCRIPTION",
    "LAB_REPORT", "DISCHARGE_SUMMARY", "OP_BILL_RECEIPT", "PHARMACY_INVOICE", "IMAGING_REPORT", "DIAGNOSTIC_ORDER", "PROCEDURE_REPORT", "MEDICAL_CERTIFICATE",
    "CLINICAL_NOTE", "OTHER_MEDICAL_DOCUMENT",
]
#: Fields that must be there: of the payload, and of every entry of an array.
REQUIRED = [
    "documentType", "documentTitle", "documentDate", "diagnoses.name", "diagnoses.confidence", "medications.medicineName", "medications.confidence", "labResults.testName", "labResults.value",
    "labResults.confidence", "procedures.name", "procedures.confidence", "investigations.imaging.studyName", "investigations.imaging.confidence", "unreadableSections.description",
    "unmappedDocumentedInformation.text",
]


def loaded(payloads: DataFrame, required: list[str] | None = None, types: list[str] | None = None, *, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(payloads with ``p`` by the declared schema, rejects with ``reasons``), by the required fields and the types that are allowed.

    A text that is null, no JSON or of other shapes than the schema's goes to the rejects as malformed, in the same pass.
    """
    broken = "corrupt_record__"
    schema = T.StructType([*PAYLOAD.fields, T.StructField(broken, T.StringType())])
    p = F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})
    rows = payloads.withColumn("p", p)
    malformed = F.col(payload).isNull() | F.col("p").isNull() | F.col(f"p.{broken}").isNotNull()

    def lacking(path: str):
        """Whether a field is null, or in any entry where the path goes through an array."""
        at, kind, parts = F.col("p"), PAYLOAD, path.split(".")
        for k, name in enumerate(parts):
            kind, at = kind[name].dataType, at[name]
            if isinstance(kind, T.ArrayType) and k < len(parts) - 1:
                return F.exists(at, lambda x: x[parts[k + 1]].isNull())
        return at.isNull()

    kind = F.col("p.documentType")
    checks = [F.when(lacking(r), F.lit(f"{r} is missing")) for r in (REQUIRED if required is None else required)]
    checks.append(F.when(~kind.isin(DOCUMENT_TYPES if types is None else types), F.lit("documentType is unknown")))
    reasons = F.when(malformed, F.array(F.lit("malformed"))).otherwise(F.array_compact(F.array(*checks)))
    rows = rows.withColumn("reasons", reasons)
    good = rows.where(F.size("reasons") == 0).drop("reasons").withColumn("p", F.col("p").dropFields(broken))
    return good, rows.where(F.size("reasons") > 0).drop("p")
