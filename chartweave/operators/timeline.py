"""Timeline events, disease journeys, encounters and the patient graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules
from ..functions.norm import any_of, canonical, leading_number
from .facts import not_billing
from .folds import folded
from .ranges import cut, same_key, segments, summed


def or_empty(name: str):
    return F.coalesce(name, F.lit(""))


def events(records: DataFrame, documents: DataFrame, diagnoses: DataFrame, medications: DataFrame, labs: DataFrame, procedures: DataFrame) -> DataFrame:
    """Timeline events of verified facts that do not come from bills, dated by their records."""
    def say(facts, kind, title, summary):
        sure = facts.where("verification_status = 'verified'")
        return sure.select("id", "patient_id", "record_id", "source_document_id", F.lit(kind).alias("event_type"), title.alias("title"), summary.alias("summary"))

    dose = F.concat(F.lit("Dosage: "), or_empty("dosage"), F.lit(" "), or_empty("strength"), F.lit(". Frequency: "), or_empty("frequency"), F.lit(". Duration: "), or_empty("duration"), F.lit("."))
    result = F.concat(F.lit("Result: "), "value", F.lit(" "), or_empty("unit"), F.when(F.col("abnormal_flag"), ". Flagged as ABNORMAL.").otherwise("."))
    rows = (
        say(diagnoses, "Diagnosis", F.concat(F.lit("Diagnosed with "), "name"), F.coalesce("notes", F.lit("Diagnosis verified.")))
        .unionByName(say(medications, "Medication Start", F.concat(F.lit("Started Medication: "), "medicine_name"), dose))
        .unionByName(say(labs, "Lab Test", F.concat(F.lit("Lab Result: "), "test_name"), result))
        .unionByName(say(procedures, "Procedure", F.concat(F.lit("Procedure: "), "name"), F.coalesce("notes", F.lit("Procedure verified."))))
    )
    return not_billing(rows, documents).join(records, "record_id").drop("record_id")


def recent(timeline: DataFrame, n: int = 4) -> DataFrame:
    """The ``n`` newest events of each patient."""
    order = W.partitionBy("patient_id").orderBy(F.desc("event_date"), F.desc("id"))
    return timeline.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def by_year(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("patient_id", F.year("event_date").alias("year"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def search(timeline: DataFrame, words: str, facet: str = "All") -> DataFrame:
    """Events whose title, summary, hospital or doctor (if there are such columns) contains the words, of a facet."""
    searched = [c for c in ("title", "summary", "hospital", "doctor") if c in timeline.columns]
    text = reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(words.lower()), F.lit(False)) for c in searched))
    kinds = {
        "All": F.lit(True), "Diagnoses": F.col("event_type") == "Diagnosis", "Medications": F.col("event_type").startswith("Medication"), "Labs": F.col("event_type") == "Lab Test",
        "Hospitalizations": F.col("event_type") == "Hospitalization", "Procedures": F.col("event_type").isin("Procedure", "Surgery"),
    }
    return timeline.where(text & kinds[facet])


def journey_status(status, is_chronic, notes):
    text = F.lower(F.coalesce(notes, F.lit("")))
    base = F.when(status == "verified", "Confirmed").when(status == "corrected", "Confirmed (Corrected)").otherwise("Detected")
    return (
        F.when(text.contains("worsening") | text.contains("progression"), "Progressing")
        .when(text.contains("improving") | text.contains("resolved"), "Resolved")
        .when(is_chronic, "Chronic (Stable)")
        .otherwise(base)
    )


def journeys(diagnoses: DataFrame) -> DataFrame:
    """Each patient's canonical diagnoses: the number of milestones, the last status, all in order, and as ``timeline`` (date, status, notes, document)."""
    document = F.col("source_document_id") if "source_document_id" in diagnoses.columns else F.lit(None).cast("string")
    step = diagnoses.select(
        "patient_id", canonical(F.col("name"), "diagnosis").alias("canonical"), "created_on", "id", or_empty("notes").alias("notes"), document.alias("document_id"),
        journey_status(F.col("verification_status"), F.col("is_chronic"), F.col("notes")).alias("status"),
    )
    steps = F.sort_array(F.collect_list(F.struct("created_on", "id", "status", "notes", "document_id")))
    timeline = F.transform("steps", lambda s: F.struct(s["created_on"].alias("date"), s["status"].alias("status"), s["notes"].alias("notes"), s["document_id"].alias("document_id")))
    rows = step.groupBy("patient_id", "canonical").agg(steps.alias("steps"))
    last = F.get("steps", F.size("steps") - 1)["status"]
    return rows.select("patient_id", "canonical", last.alias("status"), F.size("steps").alias("milestones"), F.array_join("steps.status", " > ").alias("path"), timeline.alias("timeline"))


ENCOUNTERS = "document_id string, patient_id string, segment long, encounter int, named string, hospital string, doctor string, day int, place int, documents int"
#: Days from an encounter's first document within which another may belong to it.
ENCOUNTER_DAYS = 3
#: Documents of a patient above which the patient is several tasks' work.
BUSY = 100_000


class Encounters:
    """A patient's encounters that may still take documents, which come in order of their dates (days since 1970).

    A document belongs to the first encounter that began at most three days before and has the same hospital or doctor, or
    if all four are unknown; it fills what the encounter lacks. Those that began earlier are told and forgotten. One without a date is an
    encounter of its own.
    """

    def __init__(self, key: object):
        self.number, self.open = 0, []

    def told(self, e: list) -> list[tuple]:
        patient, segment, number, named, hospital, doctor, day, docs, _, _ = e
        return [(i, patient, segment, number, named, hospital, doctor, day, k, len(docs)) for k, i in enumerate(docs)]

    def row(self, key, patient, segment, id_, day, hospital, doctor) -> list[tuple]:
        if day is None:
            self.number += 1
            return self.told([patient, segment, self.number, hospital or None, hospital or None, doctor or None, None, [id_], None, None])
        out, first = [], day - ENCOUNTER_DAYS
        if self.open and self.open[0][6] < first:
            out = [row for e in self.open if e[6] < first for row in self.told(e)]
            self.open = [e for e in self.open if e[6] >= first]
        hospital, doctor = hospital or None, doctor or None
        place, person = hospital and hospital.lower().strip(), doctor and doctor.lower().strip()
        for e in self.open:
            if (place is not None and place == e[8]) or (person is not None and person == e[9]) or not (hospital or e[4] or doctor or e[5]):
                e[7].append(id_)
                if e[4] is None:
                    e[4], e[8] = hospital, place
                if e[5] is None:
                    e[5], e[9] = doctor, person
                break
        else:
            self.number += 1
            self.open.append([patient, segment, self.number, hospital, hospital, doctor, day, [id_], place, person])
        return out

    def end(self) -> list[tuple]:
        return [row for e in self.open for row in self.told(e)]


def encounters(documents: DataFrame, busy: int = BUSY) -> DataFrame:
    """The encounter of every document, numbered from 1 per patient, with its first date, the document's ``place`` in it (from 0) and its number of ``documents``.

    A patient's documents are folded in order. No encounter outlives three days, so patients with more than ``busy`` documents are told apart at longer
    pauses, what lies between two being folded by itself; running sums over the pauses then number their encounters.
    """
    rows = documents.select("patient_id", "id", "created_on", "hospital", "doctor")
    key, day = same_key("patient_id"), F.datediff("created_on", F.lit("1970-01-01").cast("date")).alias("day")
    many = cut(rows.groupBy(key.alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > busy).select("of"))
    title = F.coalesce(F.concat(F.lit("Admission at "), "named"), F.concat(F.lit("Doctor Visit on "), F.date_format("date", "MMM d, yyyy")))

    def told(dealt: DataFrame) -> DataFrame:
        found = folded(dealt.select("key", "patient_id", "segment", "id", day, "hospital", "doctor"), "key", ["day", "id"], Encounters, ENCOUNTERS)
        return found.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")))

    shown = lambda found: found.select("document_id", "patient_id", "encounter", title.alias("title"), "hospital", "doctor", "date", "place", "documents")
    none = F.lit(None).cast("long").alias("segment")
    if many.isEmpty():
        return shown(told(rows.select("*", F.col("patient_id").alias("key"), none)))
    rows = rows.withColumn("of", key)
    few = told(rows.join(many, "of", "left_anti").select("*", F.col("patient_id").alias("key"), none))
    parts = segments(rows.join(many, "of", "left_semi"), "patient_id", ["created_on", "id"], lambda before, now: F.datediff(now["created_on"], before["created_on"]) > ENCOUNTER_DAYS)
    found = cut(told(parts.withColumn("key", F.concat_ws("\x1f", "segment", "patient_id"))))
    found = found.withColumn("of", key)
    sizes = found.groupBy("of", "segment").agg(F.max("encounter").cast("long").alias("n"))
    sizes = summed(sizes, "of", ["segment"], F.col("n"), "until").select("of", "segment", (F.col("until") - F.col("n")).cast("int").alias("earlier"))
    found = found.join(sizes, ["of", "segment"]).withColumn("encounter", F.col("encounter") + F.col("earlier"))
    return shown(few).unionByName(shown(found))


def with_encounters(facts: DataFrame, found: DataFrame, date) -> DataFrame:
    """Facts with the title of their document's encounter (``encounter_title``), else one named by ``date``, and whether that encounter is one of the fact's patient (``is_own``)."""
    titles = found.select(F.col("document_id").alias("source_document_id"), F.col("title").alias("own_title"), F.col("patient_id").alias("met_by"))
    made = F.concat(F.lit("Encounter on "), F.date_format(date, "MMM d, yyyy"))
    rows = facts.join(titles, "source_document_id", "left").withColumn("encounter_title", F.coalesce("own_title", made))
    own = F.coalesce(F.col("met_by") == F.col("patient_id"), F.lit(False)) & F.col("own_title").isNotNull()
    return rows.withColumn("is_own", own).drop("own_title", "met_by")


def node_id(patient, kind, name):
    return F.sha2(F.concat_ws("|", patient, kind, name), 256)


NODE_PROPERTIES = "map<string,string>"
#: Properties by what they are of, in the order of keys: rows carry the texts alone, keys come to those that are left.
KEYS = {
    "none": [], "visit": ["date", "doctor_name", "documents_count", "hospital_name"], "dated": ["date"],
    "diagnosis": ["confidence", "is_chronic", "notes", "verification_status"], "diagnosis met": ["confidence", "evidence_text"], "diagnosis had": ["is_chronic"],
    "medication": ["confidence", "duration", "end_date", "frequency", "generic_name", "instructions", "reason", "route", "start_date", "strength", "verification_status"],
    "medication met": ["dosage", "duration", "instructions"], "medication had": ["end_date", "start_date"],
    "test": ["unit"], "result": ["abnormal_flag", "confidence", "reference_range", "test_date", "unit", "value"], "procedure": ["confidence", "date", "notes", "surgeon_name"],
}
FORM = {name: k for k, name in enumerate(KEYS, 1)}
#: Facts by their stage in the order of building.
FACTS = {2: ("Diagnosis", "diagnosis"), 3: ("Medication", "medication"), 4: ("Lab Result", "result"), 5: ("Procedure", "procedure")}


def properties(form: Column, texts: Column) -> Column:
    """A map of ``texts`` by the keys of a form."""
    keys = F.array(*(F.array(*map(F.lit, ks)).cast("array<string>") for ks in KEYS.values()))
    return F.map_from_arrays(F.element_at(keys, form), texts)


def texts_of(df: DataFrame, form: str, **names: str) -> Column:
    """A row's texts for the keys of a form, each in the column of that name (or of ``names``); null if ``df`` lacks it."""
    columns = (names.get(k, k) for k in KEYS[form])
    return F.array(*(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in columns))


def fact_nodes(diagnoses: DataFrame, medications: DataFrame, labs: DataFrame, procedures: DataFrame, found: DataFrame) -> DataFrame:
    """All facts (``patient_id``, ``id``, ``stage``, ``name``, ``document_id``, ``date``) with ``encounter_title`` and ``is_own`` of ``with_encounters``, and the texts of
    their properties (``own``), of those of the edges from the encounter (``met``) and from the patient (``had``). A lab result is one row of two nodes; its ``test`` is its
    test's name, null for others."""
    sure, none = {"confidence": "confidence_score"}, F.array().cast("array<string>")

    def rows(df, stage, date, name, own, met, had=none, test=None):
        test = F.lit(None).cast("string") if test is None else test
        return df.select("patient_id", "id", "source_document_id", F.lit(stage).alias("stage"), date.alias("date"), name.alias("name"), test.alias("test"), own.alias("own"), met.alias("met"), had.alias("had"))

    d, m, l, p = diagnoses, medications, labs, procedures
    result = F.concat("test_name", F.lit(": "), "value", F.lit(" "), F.coalesce("unit", F.lit("")))
    every = reduce(DataFrame.unionByName, (
        rows(d, 2, F.col("created_on"), canonical(F.col("name"), "diagnosis"), texts_of(d, "diagnosis", **sure), texts_of(d, "diagnosis met", evidence_text="source_text", **sure), texts_of(d, "diagnosis had")),
        rows(m, 3, F.col("created_on"), canonical(F.col("medicine_name"), "medication"), texts_of(m, "medication", **sure), texts_of(m, "medication met"), texts_of(m, "medication had")),
        rows(l, 4, F.col("test_date"), result, texts_of(l, "result", **sure), texts_of(l, "dated", date="test_date"), test=F.col("test_name")),
        rows(p, 5, F.col("done_on"), F.col("name"), texts_of(p, "procedure", date="done_on", **sure), texts_of(p, "dated", date="done_on")),
    ))
    return with_encounters(every, found, F.col("date")).withColumnRenamed("source_document_id", "document_id")


def of_stage(values: dict[int, object]) -> Column:
    return reduce(lambda chain, k: chain.when(F.col("stage") == k, values[k]), values, F)


def graph_nodes(patients: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """One node for each patient, entity type and name, as the first that is built has it: ``first_id``, ``properties``, ``evidence_count``, ``source_documents``.

    The order of building is: the patient; encounters with their hospitals and doctors; diagnoses, medications, lab results, procedures by id, each before the encounter
    that is made for it where its document has none. ``found``: of ``encounters``; ``facts``: of ``fact_nodes``.
    """
    col, lit = F.col, F.lit
    kinds = "stage int, number int, o string, step int"

    def node(kind, name, form, own, *order):
        at = F.struct(*order).cast(f"struct<{kinds.replace(' ', ':').replace(',:', ',')}>")
        return F.struct(kind.alias("entity_type"), name.alias("canonical_name"), at.alias("at"), form.alias("form"), own.alias("texts"))

    zero, no, none = lit(0), lit(""), F.array().cast("array<string>")
    people = patients.select(col("id").alias("patient_id"), col("id").alias("first_id"), lit(None).cast("string").alias("document_id"), F.array(node(lit("Patient"), lit("Patient Profile"), lit(FORM["none"]), none, zero, zero, no, zero)).alias("nodes"))
    met = texts_of(found, "visit", hospital_name="hospital", doctor_name="doctor", documents_count="documents")
    visit = lambda kind, name, form, own, k: node(lit(kind), col(name), lit(FORM[form]), own, lit(1), col("encounter"), no, col("place") * 3 + k)
    visits = found.select("patient_id", col("document_id").alias("first_id"), "document_id", F.array(visit("Encounter", "title", "visit", met, 0), visit("Hospital", "hospital", "none", none, 1), visit("Doctor", "doctor", "none", none, 2)).alias("nodes"))
    fact = lambda kind, name, form, own, step: node(kind, name, form, own, col("stage"), zero, col("id"), lit(step))
    kind, form = of_stage({k: v[0] for k, v in FACTS.items()}), of_stage({k: FORM[v[1]] for k, v in FACTS.items()})
    result = col("stage") == 4
    test = fact(lit("Lab Test"), col("test"), lit(FORM["test"]), F.array(F.get("own", lit(KEYS["result"].index("unit")))), 0)
    # an encounter of the patient's own documents is built before any that a fact would make
    made = fact(lit("Encounter"), col("encounter_title"), lit(FORM["dated"]), F.array(col("date").cast("string")), 9)
    seen = facts.select("patient_id", col("id").alias("first_id"), "document_id", F.array(fact(kind, col("name"), form, col("own"), 1), F.when(result, test), F.when(~col("is_own"), made)).alias("nodes"))
    every = reduce(DataFrame.unionByName, (df.select("patient_id", "first_id", col("document_id").cast("string"), F.explode("nodes").alias("n")).select("patient_id", "first_id", "document_id", "n.*") for df in (people, visits, seen)))
    first = F.min_by(F.struct("first_id", "document_id", "form", "texts"), "at").alias("x")
    out = every.where("canonical_name is not null").groupBy("patient_id", "entity_type", "canonical_name").agg(first)
    return out.select(
        "patient_id", "entity_type", "canonical_name", "x.first_id", node_id(col("patient_id"), col("entity_type"), col("canonical_name")).alias("node_id"), properties(col("x.form"), col("x.texts")).alias("properties"),
        lit(1).alias("evidence_count"), F.array_compact(F.array("x.document_id")).alias("source_documents"),
    )


def graph_edges(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges (``patient_id``, ``source``, ``target``, ``relationship_type``, ``properties``) by node keys alone; repeated ones stay."""
    col, lit = F.col, F.lit
    ends = lambda kind, name: F.struct(kind.alias("kind"), name.alias("name"))
    end = lambda kind, name: ends(lit(kind), col(name) if kind != "Patient" else lit("Patient Profile"))
    edge = lambda source, target, relation, form, own: F.struct(source.alias("source"), target.alias("target"), relation.alias("relationship_type"), form.alias("form"), own.alias("texts"))
    dated, day = lit(FORM["dated"]), F.array(col("date").cast("string"))
    met = F.array(
        edge(end("Patient", ""), end("Encounter", "title"), lit("belongs_to_encounter"), dated, day),
        F.when(col("hospital").isNotNull(), edge(end("Encounter", "title"), end("Hospital", "hospital"), lit("performed_at"), dated, day)),
        F.when(col("doctor").isNotNull(), edge(end("Encounter", "title"), end("Doctor", "doctor"), lit("ordered_by"), dated, day)),
    )
    own = ends(of_stage({k: v[0] for k, v in FACTS.items()}), col("name"))
    relation = of_stage({2: "diagnosed_with", 3: "prescribed", 4: "ordered_by", 5: "belongs_to_encounter"})
    form = of_stage({2: FORM["diagnosis met"], 3: FORM["medication met"], 4: FORM["dated"], 5: FORM["dated"]})
    had = of_stage({2: FORM["diagnosis had"], 3: FORM["medication had"]})
    seen = F.array(
        edge(end("Encounter", "encounter_title"), own, relation, form, col("met")),
        F.when(col("stage").isin(2, 3), edge(end("Patient", ""), own, relation, had, col("had"))),
        # a result's name starts with its test's
        F.when(col("stage") == 4, edge(ends(lit("Lab Test"), F.expr("substring(name, 1, locate(': ', name) - 1)")), own, lit("caused"), dated, day)),
    )
    rows = [df.select("patient_id", F.explode(edges).alias("e")).where("e is not null").select("patient_id", "e.*") for df, edges in ((found, met), (facts, seen))]
    at = lambda c: node_id(col("patient_id"), col(f"{c}.kind"), col(f"{c}.name")).alias(c)
    return rows[0].unionByName(rows[1]).select("patient_id", at("source"), at("target"), "relationship_type", properties(col("form"), col("texts")).alias("properties"))


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges of each patient."""
    a, b = nodes.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_nodes")), edges.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return a.join(b, "patient_id", "full").select("patient_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def graph_counts(patients: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """``graph_sizes`` of ``graph_nodes`` and ``graph_edges``, told from the names of nodes and from what edges a row gives, without building either."""
    name = lambda kind, x: F.struct(kind.alias("kind"), x.alias("name"))
    one = lambda when: F.when(when, 1).otherwise(0)
    people = patients.select(F.col("id").alias("patient_id"), F.array(name(F.lit("Patient"), F.lit("Patient Profile"))).alias("names"), F.lit(0).alias("edges"))
    visits = found.select(
        "patient_id", F.array(*(name(F.lit(k), F.col(c)) for k, c in (("Encounter", "title"), ("Hospital", "hospital"), ("Doctor", "doctor")))).alias("names"),
        (1 + one(F.col("hospital").isNotNull()) + one(F.col("doctor").isNotNull())).alias("edges"),
    )
    result = F.col("stage") == 4
    own, made = name(of_stage({k: v[0] for k, v in FACTS.items()}), F.col("name")), name(F.lit("Encounter"), F.col("encounter_title"))
    seen = facts.select(
        "patient_id", F.array(own, F.when(result, name(F.lit("Lab Test"), F.col("test"))), F.when(~F.col("is_own"), made)).alias("names"),
        (1 + one(F.col("stage").isin(2, 3, 4))).alias("edges"),
    )
    every = (people, visits, seen)
    a = reduce(DataFrame.unionByName, (df.select("patient_id", F.explode("names").alias("x")).select("patient_id", "x.*") for df in every)).where("name is not null").distinct()
    a = a.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    b = reduce(DataFrame.unionByName, (df.select("patient_id", "edges") for df in every)).groupBy("patient_id").agg(F.sum("edges").alias("n_edges")).where("n_edges > 0")
    return a.join(b, "patient_id", "full").select("patient_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def plain_number(x):
    """A double without a fraction of zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def insights(labs: DataFrame, medications: DataFrame, documents: DataFrame) -> DataFrame:
    """(``patient_id``, ``title``, ``description``, ``severity``, ``citations``) of rising HbA1c, falling haemoglobin, frequent antibiotics and stays.

    ``citations``: structs of document, its title, date and snippet, by date and id.
    """
    names = documents.select(F.col("id").alias("source_document_id"), "file_name")
    titled = lambda df: df.join(names, "source_document_id", "left").withColumn("document_title", F.coalesce("file_name", F.lit("Medical Document")))
    cited = lambda date, snippet: F.sort_array(F.collect_list(F.struct(date.alias("date"), "id", F.col("source_document_id").alias("document_id"), "document_title", snippet.alias("snippet"))))
    day = lambda c: F.date_format(c, "MMM d, yyyy")

    def pair(kind, hit, unit, risen, title, said, critical):
        rows = titled(labs.where(hit)).withColumn("x", leading_number(F.col("value")))
        order = F.struct("test_date", "id")
        g = rows.groupBy("patient_id").agg(
            F.min_by(F.struct("x", "test_date"), order).alias("a"), F.max_by(F.struct("x", "test_date"), order).alias("z"), F.count(F.lit(1)).alias("n"),
            cited(F.col("test_date"), F.concat("test_name", F.lit(": "), "value", F.lit(unit))).alias("citations"),
        ).where("n >= 2").where(risen(F.col("a.x"), F.col("z.x")))
        text = F.format_string(said, plain_number(F.col("a.x")), day("a.test_date"), plain_number(F.col("z.x")), day("z.test_date"))
        return g.select("patient_id", F.lit(title).alias("title"), text.alias("description"), F.when(critical(F.col("z.x")), "critical").otherwise("warning").alias("severity"), "citations")

    low = F.lower("test_name")
    sugar = pair("hba1c", low.contains("hba1c"), "%", lambda a, z: z > a, "Diabetes Progression Risk (Rising HbA1c)",
        "Your HbA1c has increased from %s%% on %s to %s%% on %s, indicating worsening glycemic control and potential diabetes progression risk.", lambda z: z >= 6.5)
    blood = pair("hemoglobin", low.isin("hemoglobin", "hb"), " g/dL", lambda a, z: (z < a) & (z < 12), "Anemia Alert (Falling Hemoglobin)",
        "Your Hemoglobin level has fallen from %s g/dL on %s to %s g/dL on %s, indicating potential development or worsening of anemia.", lambda z: z < 10)

    def often(rows, least, date, snippet, title, said, severity):
        g = rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), cited(date, snippet).alias("citations")).where(F.col("n") >= least)
        return g.select("patient_id", F.lit(title).alias("title"), F.format_string(said, "n").alias("description"), F.lit(severity).alias("severity"), "citations")

    taken = titled(medications.where(any_of(F.lower("medicine_name"), rules.ANTIBIOTICS)))
    drugs = often(taken, 3, F.coalesce("start_date", "created_on"), F.concat(F.lit("Prescribed: "), "medicine_name", F.lit(" ("), F.coalesce("duration", F.lit("Short course")), F.lit(")")), "Frequent Antibiotic Use Warning",
        "You have been prescribed antibiotic courses %d times recently. Frequent antibiotic usage can increase the risk of gut microbiome disruption and antibiotic resistance.", "warning")
    left = (F.lower("category") == "discharge summary") | F.lower("file_name").contains("discharge")
    stays = documents.where(F.col("processing_status").isin("completed", "awaiting_review") & left).withColumns({"source_document_id": F.col("id"), "document_title": F.coalesce("file_name", F.lit("Discharge Summary"))})
    stays = often(stays, 2, F.col("created_on"), F.concat(F.lit("Hospitalization Record: "), "file_name"), "Frequent Hospitalizations / Readmission Alert",
        "The medical timeline records %d hospital discharge events, suggesting a high rate of hospitalization. Closer physician monitoring is recommended to prevent readmission.", "critical")
    return reduce(DataFrame.unionByName, (sugar, blood, drugs, stays))
