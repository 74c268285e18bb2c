"""What a harness and a generator load: tiers of a company, its graph, canon, questions, corpus and checkpoints, results of runs.

Files are read by Spark, JSON lines with explicit schemas and in file order (`ord`); a missing optional file gives an empty frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import parse as P
from annalist.operators import evaluation, state
from annalist.sources.tables import artifacts, json_lines, whole_texts

EVIDENCE = "array<struct<slot_id:string,genre:string,role:string,author:string>>"
EVENTS = f"id string, type string, occurred_at string, recorded_at string, summary string, decision string, reason_canonical string, participants array<string>, alternatives_considered array<string>, category_target string, corrects_event_id string, doc_dispersal_pattern string, evidence_in_corpus {EVIDENCE}"
RELATIONS = "source string, relation string, target string"
PERSONAS = "persona_id string, display_name string, joined_year string, left_year string, role_history array<struct<from:string,to:string,role:string,manager:string>>, signature_phrases array<string>, domain_expertise array<string>, is_long_tail boolean, is_departed boolean"
CUSTOMERS = "customer_id string, name string, industry string, size string, first_year string, last_year string, outcome string, arc_summary string, narrative_roles array<string>, contract_notes string, is_active boolean"
CHANNELS = "channel string, created string, archived string, team string, kind string, purpose string, renamed_from string, peak_years array<bigint>"
SKELETON = "founding_year bigint, founders array<struct<name:string,blurb:string>>, year_arcs map<string,string>, eras array<struct<n:bigint,name:string,start:string,end:string,discipline_level:string,characterisation:string>>, products array<string>, customer_arc_count bigint, tooling array<struct<year:bigint,quarter:bigint,description:string>>"
INDEX = "slot_id string, event_id string, role string, genre string, author string, path string, chars bigint, customer_id string, emergent_pattern string, facet int"
QUESTIONS = "id string, category string, difficulty string, text string, paraphrases array<string>, ground_truth_answer string, rubric_subpoints array<struct<id:string,max_score:string,weight:string,criterion:string,fail_criterion:string,fail_if:string,facet_index:int,evidence_ids:array<string>>>, evidence_artefact_ids array<string>, evidence_artifact_ids array<string>, metadata string"
SUBMISSION = "question_id string, answer_text string, cited_artifact_ids array<string>"
REPORTS = "slot_id string, event_id string, role string, genre string, fact_count int, yes int, partial int, no int, score double, facts array<struct<fact:string,verdict:string,justification:string>>"
CHECKPOINT = "unit_id string, completed_at string, status string"
RESULT = "system string, system_version string, company string, tier string, dry_run boolean, metrics string, ingest struct<n_artifacts:bigint,tokens_stored:bigint,index_bytes:bigint,ingest_seconds:double>, queries array<struct<question_id:string,answer_text:string,cited_artifact_ids:array<string>,latency_ms:double,input_tokens:bigint,output_tokens:bigint,cost_usd:double>>, judgements array<struct<question_id:string,score:double,semantic_score:double,exact_match:boolean,faithful:boolean,failure_mode:string,input_tokens:bigint,output_tokens:bigint,cost_usd:double>>"


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def tier_dir(spark: SparkSession, root: str, tier: str, company: str) -> str:
    """The folder of a company's tier; a missing one raises."""
    path = f"{root.rstrip('/')}/{company}/{tier}"
    if not exists(spark, path):
        raise FileNotFoundError(f"no dataset at {path}")
    return path


def canon_dir(spark: SparkSession, folder: str) -> str:
    """The folder of a tier whose name ends in _canon, by name the first; its plain name if there is none."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*_canon")
    found = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(there) or []
    return min((str(f.getPath()) for f in found), default=f"{folder}/canon")


def ordered(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with their place in the file. Blank lines are no rows."""
    return json_lines(spark, path, schema, strict).withColumn("ord", F.monotonically_increasing_id())


def graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """events, relations (with ord) and personas of a tier."""
    source, canon = f"{folder}/source_of_truth", canon_dir(spark, folder)
    return {"events": json_lines(spark, f"{source}/events.jsonl", EVENTS), "relations": ordered(spark, f"{source}/relations.jsonl", RELATIONS), "personas": json_lines(spark, f"{canon}/personas.jsonl", PERSONAS)}


def canon(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The canon's people, customers (present and historical ones), channels and skeleton; the optional files may be missing."""
    at = canon_dir(spark, folder)
    customers = json_lines(spark, f"{at}/customers.jsonl", CUSTOMERS).withColumn("historical", F.lit(False))
    former = json_lines(spark, f"{at}/historical_customers.jsonl", CUSTOMERS).withColumn("historical", F.lit(True))
    skeleton = spark.read.schema(SKELETON).option("multiLine", True).json(f"{at}/skeleton.json") if exists(spark, f"{at}/skeleton.json") else spark.createDataFrame([], SKELETON)
    return {"personas": json_lines(spark, f"{at}/personas.jsonl", PERSONAS), "customers": customers.unionByName(former), "channels": json_lines(spark, f"{at}/channel_timeline.jsonl", CHANNELS), "skeleton": skeleton, "depth_arcs": depth_arcs(spark, at)}


def depth_arcs(spark: SparkSession, at: str) -> DataFrame:
    """title and body of each section of the optional depth arcs."""
    path = f"{at}/depth_arcs.md"
    text = whole_texts(spark, [path]) if exists(spark, path) else spark.createDataFrame([], "path string, text string")
    return text.select(F.explode(P.sections("text")).alias("s")).select("s.title", "s.body")


def eras(skeleton: DataFrame) -> DataFrame:
    return skeleton.select(F.explode("eras").alias("e")).select("e.*")


def tooling(skeleton: DataFrame, year: int, last: int | None = None) -> DataFrame:
    """Tools adopted by a year, in order of year and quarter; the last few if a number is given."""
    rows = skeleton.select(F.explode(F.filter("tooling", lambda t: t["year"] <= year)).alias("t")).select("t.*")
    return rows.orderBy("year", "quarter") if last is None else rows.orderBy(F.desc("year"), F.desc("quarter")).limit(last)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised artifacts of a tier: index rows whose file exists, in the index's shape of `tables.artifacts`."""
    found = graph(spark, folder)
    index = json_lines(spark, f"{folder}/corpus_index.jsonl", INDEX)
    files = whole_texts(spark, [f"{folder}/corpus"], below=True).withColumn("path", F.regexp_extract("path", rf"{folder.split(':')[-1].rstrip('/')}/(.*)$", 1))
    return artifacts(index, files, found["events"], found["personas"])


def up_to(rows: DataFrame, day: str, column: str = "timestamp") -> DataFrame:
    """Rows dated by a day; undated ones stay out."""
    return rows.where(F.substring(column, 1, 10) <= F.lit(day))


def questions(spark: SparkSession, folder: str, emergent: bool = False) -> DataFrame:
    """The validated questions of a tier; a missing file raises. With emergent, drafts and emergent questions together."""
    names = ["questions_draft.jsonl", "emergent_questions.jsonl"] if emergent else ["benchmark_v0.0.jsonl"]
    if not exists(spark, f"{folder}/{names[0]}"):
        raise FileNotFoundError(f"no questions at {folder}/{names[0]}")
    rows = json_lines(spark, f"{folder}/{names[0]}", QUESTIONS)
    for name in names[1:]:
        rows = rows.unionByName(json_lines(spark, f"{folder}/{name}", QUESTIONS))
    return evaluation.questions(rows)


def submission(spark: SparkSession, path: str) -> DataFrame:
    """Predictions by question_id; the last line of one wins, a line without its keys fails."""
    return evaluation.submission(ordered(spark, path, SUBMISSION), "ord")


def reports(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, REPORTS)


def done(spark: SparkSession, path: str) -> DataFrame:
    """Units that a checkpoint names; malformed lines and lines without a unit do not count."""
    return json_lines(spark, path, CHECKPOINT, strict=False).where("unit_id <> ''").select("unit_id").distinct()


def results(spark: SparkSession, root: str, baseline: str = "reference") -> DataFrame:
    """Runs under root/SYSTEM/*.json; files that are no JSON object are left out, and so is the baseline system."""
    if not exists(spark, root):
        return spark.createDataFrame([], RESULT)
    rows = spark.read.schema(RESULT + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(root)
    return rows.where("_bad is null and not system <=> '" + baseline + "'").drop("_bad")


def measured(runs: DataFrame) -> DataFrame:
    """Runs whose metrics hold a record of usage."""
    return runs.where(F.get_json_object("metrics", "$.usage").isNotNull())


def usage(runs: DataFrame) -> DataFrame:
    """Tokens, costs and calls of each run: an answer that used no token was no call."""
    add = lambda xs, kind: F.aggregate(F.coalesce(xs, F.array().cast(f"array<{kind}>")), F.lit(0).cast(kind), lambda a, x: a + F.coalesce(x, F.lit(0).cast(kind)))
    q, j = F.col("queries"), F.col("judgements")
    used = F.size(F.filter(q, lambda x: (x["input_tokens"] > 0) | (x["output_tokens"] > 0)))
    return runs.select(
        "system", "tier", used.alias("answer_calls"), add(F.transform(q, lambda x: x["input_tokens"]), "bigint").alias("answer_in"), add(F.transform(q, lambda x: x["output_tokens"]), "bigint").alias("answer_out"),
        F.size("judgements").alias("judge_calls"), F.round(add(F.transform(q, lambda x: x["cost_usd"]), "double") + add(F.transform(j, lambda x: x["cost_usd"]), "double"), 4).alias("measured_usd"),
    )


def extracted(runs: DataFrame) -> DataFrame:
    """system, tier, question_id, answer_text, cited_artifact_ids: a submission out of each run's record; missing texts are empty, missing citations none."""
    q = runs.select("system", "tier", F.explode("queries").alias("q"))
    return q.select("system", "tier", "q.question_id", F.coalesce("q.answer_text", F.lit("")).alias("answer_text"), F.coalesce("q.cited_artifact_ids", F.array().cast("array<string>")).alias("cited_artifact_ids"))


def judged(questions_: DataFrame, predictions: DataFrame, system: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Every question with its answer and verdict, as `evaluation.records` takes them; without verdicts the dry run's: score 0."""
    rows = evaluation.answered(questions_.select("id", "public_category", "difficulty"), predictions).withColumns({"system": F.lit(system), "latency_ms": F.lit(0.0), "cost_usd": F.lit(0.0)})
    if verdicts is None:
        return rows.withColumns({"score": F.lit(0.0), "semantic_score": F.lit(0.0), "exact_match": F.lit(False), "faithful": F.lit(True), "failure_mode": F.lit("dry_run")})
    v = verdicts.select(F.col("question_id").alias("id"), "score", "semantic_score", "exact_match", "faithful", "failure_mode")
    return rows.join(v, "id", "left").fillna({"score": 0.0, "semantic_score": 0.0, "exact_match": False, "faithful": True, "failure_mode": "none"})


def collided(index: DataFrame, files: DataFrame) -> DataFrame:
    """Artefacts whose header names another slot than their path does: path, slot_id of the path, header_id."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slot_id"), F.regexp_extract("text", r"(?m)^slot_id:\s*(\S+)", 1).alias("header_id"))
    return named.join(index.select("path"), "path", "left_semi").where((F.col("header_id") != "") & (F.col("header_id") != F.col("slot_id")))


def tier_size(index: DataFrame, questions_: DataFrame) -> DataFrame:
    """artifacts, tokens (a quarter of all characters) and questions of a tier."""
    a = index.agg(F.count("*").alias("artifacts"), F.expr("coalesce(sum(chars), 0) div 4").alias("tokens"))
    return a.crossJoin(questions_.agg(F.count("*").alias("questions")))  # a row each


def write_record(record: DataFrame, path: str) -> None:
    """The record of one run as JSON, in the place of an older one."""
    record.coalesce(1).write.mode("overwrite").json(path)


def forget(spark: SparkSession, path: str) -> bool:
    """Deletes a checkpoint; whether there was one."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """question_id, query and judge (JSON texts): the last pair of each question in a partial run's log; torn lines and a missing log are passed over."""
    fields = "query string, judge string"
    lines = spark.read.option("recursiveFileLookup", True).text(path).where("trim(value) <> ''") if exists(spark, path) else spark.createDataFrame([], "value string")
    numbered = lines.withColumn("_line", F.monotonically_increasing_id()).select("_line", F.from_json("value", fields).alias("p"))
    known = numbered.select(F.get_json_object("p.query", "$.question_id").alias("question_id"), "p.query", "p.judge", "_line").where("question_id is not null and judge is not null")
    return state.last_wins(known, ["question_id"], ["_line"]).drop("_line")


def to_run(questions_: DataFrame, partial: DataFrame) -> DataFrame:
    """Questions that a partial run has no pair of."""
    return questions_.join(partial.select(F.col("question_id").alias("id")), "id", "left_anti")


def write_benchmark(questions_: DataFrame, passed: DataFrame, path: str) -> None:
    """The questions that passed, as JSON lines in the place of an older set: a semi-join by id."""
    questions_.join(passed.select("id"), "id", "left_semi").write.mode("overwrite").json(path)
