"""Every registered query: an operator or plan over the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import prompts
from runloom.functions import report as rep
from runloom.functions import text as txt
from runloom.functions import variant
from runloom.operators import asof, calls, catalog, chunks, completion, corpus, runlog
from runloom.plans import accept, backfeed, first_pass, retrieval, single_flow, stages
from runloom.session import new_folder
from runloom.sources import bucketed, functions, tables
from runloom.streaming import corpus as corpus_stream
from runloom.streaming import index as digest_index
from runloom.streaming import matching, running
from runloom.streaming import replies as reply_stream
from runloom.streaming import runs as run_stream
from runloom.streaming import sinks
from workloads import facade

Query = Callable[[SparkSession, str], DataFrame]

LISTED_IDS = [2, 2, 7, 11, 999999999]
ONE_KEY = ("8", "pA", "m0", 0.5)
_REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    _REGISTRY[build.__name__] = build
    return build


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- corpus -----------------------------------------------------------------


@query
def corpus_scan(spark, sf):
    return facade.corpus(spark, sf)


@query
def corpus_by_ids(spark, sf):
    good = facade.table(spark, sf, "labels").where("quality = 1")
    return corpus.by_ids(facade.corpus(spark, sf), good.select(F.col("doc_id").alias("id")))


@query
def corpus_by_id_list(spark, sf):
    return corpus.by_ids(facade.corpus(spark, sf), LISTED_IDS)


@query
def corpus_by_ids_empty(spark, sf):
    """How many documents an empty list selects, by itself and under the batch rule."""
    docs = facade.corpus(spark, sf)
    listed = corpus.by_ids(docs, []).select(F.lit("listed").alias("rule"))
    batch = corpus.select_for_batch(docs, []).select(F.lit("batch").alias("rule"))
    return listed.unionByName(batch).groupBy("rule").agg(F.count("*").alias("documents"))


@query
def corpus_for_batch(spark, sf):
    return corpus.select_for_batch(facade.corpus(spark, sf), [])


@query
def corpus_from_entries(spark, sf):
    return corpus.from_entries(facade.entries(spark, sf))


@query
def insert_if_absent(spark, sf):
    return corpus.insert_if_absent(
        facade.triples(spark, sf), facade.labelled_triples(spark, sf), "id"
    )


@query
def insert_skipped(spark, sf):
    new = facade.triples(spark, sf)
    fresh = corpus.insert_if_absent(new, facade.labelled_triples(spark, sf), "id")
    return corpus.skipped(new, fresh, "id")


@query
def import_corpus(spark, sf):
    """Imported twice: the second import finds everything present."""
    root = new_folder(spark, "import")
    tables.import_corpus(spark, facade.entries(spark, sf), root)
    tables.import_corpus(spark, facade.entries(spark, sf), root)
    return tables.corpus(spark, root)


@query
def import_repeated_positions(spark, sf):
    """Files that each count from 0: positions repeat, some are missing."""
    root = new_folder(spark, "import")
    pos = F.when(F.col("pos") % 7 > 0, F.col("pos") % 50)
    tables.import_corpus(spark, facade.entries(spark, sf).withColumn("pos", pos), root)
    return tables.corpus(spark, root)


@query
def artifact_keys(spark, sf):
    return facade.corpus(spark, sf).select(
        "id", txt.artifact_key(F.col("id"), F.col("srs_title")).alias("srs_id")
    )


# --- run log ----------------------------------------------------------------


@query
def run_log_append(spark, sf):
    """Two appends; the ids of the second go on where the first ended."""
    root = new_folder(spark, "log")
    log = facade.run_log(spark, sf).withColumnRenamed("id", "event_id")
    tables.ensure_tables(spark, root)
    tables.append_runs(spark, log.where("event_type <> 'error'"), root, "event_id")
    tables.append_runs(spark, log.where("event_type = 'error'"), root, "event_id")
    return tables.run_log(spark, root).select(
        "id", "srs_id", "event_type", "llm_provider", "llm_model", "temperature",
        "original_srs_text", "similarity_score_orig_srs",
        F.octet_length("uml_image_data_orig_srs").cast("long").alias("image_bytes"),
    )


@query
def append_repeated_ids(spark, sf):
    """Rows appended by an id that repeats and is missing for some; every row gets its own."""
    root = new_folder(spark, "log")
    log = facade.run_log(spark, sf).withColumn("by", F.col("srs_id").cast("long"))
    tables.append_runs(spark, log.withColumnRenamed("id", "event"), root, "by")
    ordered = tables.run_log(spark, root).select("id", "srs_id")
    spans = ordered.groupBy("srs_id").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.count("*").alias("rows"), F.countDistinct("id").alias("ids"),
    )
    return spans


@query
def latest_run(spark, sf):
    keys = catalog.effective_temperature(facade.requested_keys(spark, sf), facade.MODELS)
    return runlog.lookup_latest(keys, facade.run_log(spark, sf))


@query
def latest_run_bucketed(spark, sf):
    """The same rows from a catalogue table whose buckets hold whole keys."""
    folder = new_folder(spark, "bucketed")
    table = f"usage_logs_{folder.rsplit('-', 1)[1]}"
    bucketed.create_log(spark, table, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    log = facade.run_log(spark, sf)
    bucketed.append_log(log.where("event_type <> 'error'"), table)
    bucketed.append_log(log.where("event_type = 'error'"), table)
    keys = catalog.effective_temperature(facade.requested_keys(spark, sf), facade.MODELS)
    return bucketed.latest_bucketed(keys, spark.table(table))


@query
def latest_run_as_of(spark, sf):
    """For every event the newest run, by then, of its user with the next model."""
    asked = catalog.effective_temperature(
        facade.table(spark, sf, "events").selectExpr(
            "event_id as request_id",
            "if(value > 480, null, cast(user_id as string)) as srs_id",
            "if((event_id + 1) % 5 < 3, 'pA', 'pB') as llm_provider",
            "concat('m', (event_id + 1) % 5) as llm_model",
            "0.5D as temperature",
            "ts as at",
        ),
        facade.MODELS,
    )
    found = asof.runs_as_of(asked, facade.run_log(spark, sf), ["original_srs_text", "similarity_score_orig_srs"])
    return found.drop("at")


@query
def sql_latest_run_of(spark, sf):
    """The newest run of each customer's key with one model, by a table function of SQL."""
    facade.run_log(spark, sf).createOrReplaceTempView("usage_logs")
    functions.create_functions(spark)
    facade.table(spark, sf, "customer").createOrReplaceTempView("customers")
    return spark.sql(
        """SELECT c_custkey, r.id, r.original_srs_text, improvement_label(c_custkey) AS label
        FROM customers, LATERAL latest_run_of(cast(c_custkey as string), 'pA', 'm0', 0.5D) r"""
    )


@query
def sql_extract_script(spark, sf):
    facade.replies(spark, sf).createOrReplaceTempView("replies")
    facade.run_log(spark, sf).createOrReplaceTempView("usage_logs")
    functions.create_functions(spark)
    return spark.sql("SELECT id, extract_script(script_reply) AS script FROM replies")


@query
def latest_run_by_rank(spark, sf):
    return runlog.latest_runs_by_rank(facade.run_log(spark, sf)).drop("created_at")


@query
def latest_of_one_key(spark, sf):
    return runlog.latest_of_key(facade.run_log(spark, sf), *ONE_KEY).select(
        "id", "srs_id", "llm_provider", "llm_model", "temperature", "original_srs_text"
    )


@query
def rows_of_one_key(spark, sf):
    return runlog.rows_of_key(facade.run_log(spark, sf), *ONE_KEY).select(
        "id", "event_type", "similarity_score_orig_srs"
    )


@query
def run_counts(spark, sf):
    return runlog.latest_ids(facade.run_log(spark, sf))


@query
def iteration_label(spark, sf):
    return runlog.iteration_labels(facade.run_log(spark, sf))


@query
def distinct_ids(spark, sf):
    return runlog.distinct_ids(facade.run_log(spark, sf))


@query
def facets(spark, sf):
    return runlog.facets_in_order(runlog.facets(facade.run_log(spark, sf)))


@query
def facets_of_ids(spark, sf):
    chosen = facade.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("srs_id")
    )
    return runlog.facets(facade.run_log(spark, sf), chosen)


def _compared(df: DataFrame) -> DataFrame:
    images = [f"uml_image_data_{flow}_srs_{side}" for flow in ("orig", "dist") for side in ("left", "right")]
    return df.withColumns({name: F.col(name).cast("string") for name in images})


@query
def side_by_side(spark, sf):
    log = facade.run_log(spark, sf)
    return _compared(retrieval.retrieve(log, "signup", "purchase")["compared"])


def _retrieved(spark, sf) -> dict[str, DataFrame]:
    return retrieval.retrieve(
        facade.run_log(spark, sf), "signup", "purchase", ids=["8", "11", "8", "nobody"], key=ONE_KEY
    )


@query
def retrieval_facets(spark, sf):
    return _retrieved(spark, sf)["facets"]


@query
def retrieval_rows(spark, sf):
    return _retrieved(spark, sf)["rows"].select("id", "event_type", "similarity_score_orig_srs")


@query
def retrieval_compared(spark, sf):
    """Both sides of the chosen key."""
    log = facade.run_log(spark, sf)
    found = retrieval.retrieve(log, "click", "view", key=ONE_KEY, how="full")["compared"]
    return _compared(found)


@query
def side_by_side_full(spark, sf):
    log = facade.run_log(spark, sf)
    return _compared(runlog.side_by_side(log, "view", "click", how="full"))


@query
def flows_long(spark, sf):
    flows = runlog.to_flows(facade.run_log(spark, sf))
    return flows.withColumn("image", F.col("image").cast("string"))


@query
def flows_wide(spark, sf):
    wide = runlog.from_flows(runlog.to_flows(facade.run_log(spark, sf)))
    images = ["uml_image_data_orig_srs", "uml_image_data_dist_srs"]
    return wide.withColumns({name: F.col(name).cast("string") for name in images})


@query
def image_lookup(spark, sf):
    asked = facade.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    found = runlog.image_lookup(facade.image_log(spark, sf), asked)
    return found.select("id", "status", "n_bytes", F.md5("image").alias("image_md5"))


@query
def accept_split(spark, sf):
    runs = runlog.latest_runs(facade.run_log(spark, sf), ["similarity_score_orig_srs"])
    done, again = runlog.accept_split(
        runs, F.when(F.col("run_count") > 1, F.col("similarity_score_orig_srs") >= 20)
    )
    return done.withColumn("verdict", F.lit("accept")).unionByName(
        again.withColumn("verdict", F.lit("backfeed"))
    )


# --- catalogue and prompts ---------------------------------------------------


@query
def request_fanout(spark, sf):
    return catalog.fan_out(facade.batch_documents(spark, sf), facade.MODELS, 0.5)


@query
def models_of_providers(spark, sf):
    """The models on offer to each logged provider, beside what was used of them."""
    used = (
        facade.run_log(spark, sf)
        .groupBy(F.col("llm_provider").alias("provider"), F.col("llm_model").alias("model"))
        .agg(F.count("*").alias("runs"))
    )
    models = catalog.catalog(spark, facade.MODELS)
    offered = catalog.models_for(models, "pA").unionByName(catalog.models_for(models, "pX"))
    return offered.join(used, ["provider", "model"], "left").drop("pos")


@query
def catalog_lookup(spark, sf):
    asked = facade.table(spark, sf, "events").selectExpr(
        "event_id",
        "if(event_type = 'error', 'pX', if(event_id % 5 < 3, 'pA', 'pB')) as llm_provider",
        "if(event_type = 'view', 'm9', concat('m', event_id % 5)) as llm_model",
    )
    return catalog.resolve_api(asked, facade.MODELS)


@query
def effective_temperature(spark, sf):
    return facade.run_log(spark, sf).select("id", "llm_provider", "llm_model", "temperature")


@query
def prompt_distil(spark, sf):
    return facade.corpus(spark, sf).select("id", prompts.distil(F.col("srs_content")).alias("prompt"))


@query
def prompt_generate(spark, sf):
    rows = facade.corpus(spark, sf).where(~txt.is_blank(F.col("srs_content")))
    return rows.select("id", prompts.generate(F.col("srs_content")).alias("prompt"))


@query
def prompt_similarity(spark, sf):
    return facade.replies(spark, sf).select(
        "id", prompts.similarity(F.col("script_reply"), F.col("text")).alias("prompt")
    )


@query
def prompt_regenerate(spark, sf):
    log = facade.run_log(spark, sf)
    return log.select(
        "id",
        *[
            prompts.regenerate(
                flow,
                F.col(stages.TEXT_OF[flow]),
                F.col(f"plantuml_script_{flow}_srs"),
                F.col(f"similarity_descr_{flow}_srs"),
            ).alias(f"prompt_{flow}")
            for flow in ("orig", "dist")
        ],
    )


# --- replies ------------------------------------------------------------------


@query
def strip_text(spark, sf):
    padded = facade.documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("\x1f　\n "), "text", F.lit("\t\x85 \r\n")).alias("padded"),
    )
    return padded.select("id", txt.strip(F.col("padded")).alias("stripped"))


@query
def unfence_text(spark, sf):
    return facade.replies(spark, sf).select("id", txt.unfence(F.col("reply")).alias("body"))


@query
def extract_script(spark, sf):
    return facade.replies(spark, sf).select(
        "id", txt.extract_script(F.col("script_reply")).alias("script")
    )


@query
def wrap_script(spark, sf):
    return facade.replies(spark, sf).select(
        "id", txt.wrap_script(F.col("script_reply")).alias("script")
    )


@query
def reply_status(spark, sf):
    return facade.replies(spark, sf).select("id", txt.reply_status(F.col("reply")).alias("status"))


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return rep.parse_report(facade.replies(spark, sf).select("id", "reply"), F.col("reply"))


@query
def report_parse(spark, sf):
    accepted, _ = rep.split_reports(_reports(spark, sf))
    report = F.col("report")
    return accepted.select(
        "id",
        report[rep.DESCRIPTION].alias("description"),
        report[rep.SCORE].alias("score"),
        *[rep.section_text(report, name).alias(name) for name in rep.SECTIONS],
    )


@query
def report_text(spark, sf):
    accepted, _ = rep.split_reports(_reports(spark, sf))
    return accepted.select("id", rep.analysis_text(F.col("report")).alias("analysis"))


@query
def report_rejects(spark, sf):
    _, rejected = rep.split_reports(_reports(spark, sf))
    return rejected.select("id", "reply", txt.reply_status(F.col("reply")).alias("status"))


def _noted_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of which some have keys of their own and lists with items that are no texts."""
    rows = facade.replies(spark, sf).select("id", "reply")
    noted = F.replace(
        F.replace("reply", F.lit('"similarity_score"'), F.lit('"note":{"by":["a"]},"sure":true,"similarity_score"')),
        F.lit('"missing_elements":[]'),
        F.lit('"missing_elements":[1.5,null,"x",[true]]'),
    )
    return variant.with_variant(rows.withColumn("reply", F.when(F.col("id") % 3 == 0, noted).otherwise(F.col("reply"))), F.col("reply"))


@query
def report_items(spark, sf):
    return variant.report_items(_noted_reports(spark, sf), "id")


@query
def report_extra_keys(spark, sf):
    return variant.extra_keys(_noted_reports(spark, sf), "id")


@query
def scoring_ready(spark, sf):
    rows = facade.replies(spark, sf).select(
        "id", "text", txt.extract_script(F.col("script_reply")).alias("script")
    )
    return rows.select("id", F.when(single_flow.scoring_ready(), "ready").otherwise("not ready").alias("state"))


@query
def event_tags(spark, sf):
    """Stage and flow of each turn, tagged; turns outside the two flows get no tag."""
    stage = F.when(F.col("role") == "user", "generate").when(
        F.col("role") == "assistant", "similarity"
    ).otherwise("distil")
    flow = F.when(F.col("turn") < 2, "orig").when(F.col("turn") < 6, "dist").otherwise("other")
    rows = facade.table(spark, sf, "conversations").select("conv_id", "turn", stage.alias("stage"), flow.alias("flow"))
    return rows.select(
        "conv_id", "turn", single_flow.event_type(F.col("stage"), F.col("flow")).alias("event_type")
    )


# --- chunks and chat ------------------------------------------------------------


@query
def response_text(spark, sf):
    return chunks.response_text(facade.chunks(spark, sf))


@query
def chunk_running(spark, sf):
    """Whole running texts, reported by length and digest: written out they would
    take the square of a reply's length."""
    shown = chunks.running_text(chunks.drop_empty(facade.chunks(spark, sf)))
    return shown.select(
        "request_id", "seq", F.length("running").cast("long").alias("n_chars"), F.md5("running").alias("digest")
    )


@query
def chunk_offsets(spark, sf):
    return chunks.chunk_offsets(facade.chunks(spark, sf))


@query
def chat_history(spark, sf):
    return chunks.chat_pairs(facade.table(spark, sf, "conversations"))


@query
def match_responses(spark, sf):
    """Documents as requests, assembled conversations as the recorded answers."""
    requests = facade.documents(spark, sf).select(
        F.col("doc_id").alias("request_id"), F.col("lang").alias("stage")
    )
    answers = chunks.response_text(facade.chunks(spark, sf))
    return completion.match_responses(requests, answers)


# --- plans ------------------------------------------------------------------------


def _first_pass(spark: SparkSession, sf: str) -> DataFrame:
    return first_pass.first_pass_recorded(
        facade.batch_documents(spark, sf),
        facade.recorded_responses(spark, sf),
        facade.MODELS,
        0.5,
    )


@query
def first_pass_log(spark, sf):
    rows = stages.log_rows(_first_pass(spark, sf))
    return rows.drop("run_id", "uml_image_data_orig_srs", "uml_image_data_dist_srs")


@query
def first_pass_states(spark, sf):
    return _first_pass(spark, sf).select(
        "srs_id", "llm_provider", "llm_model", "state_orig", "state_dist"
    )


@query
def first_pass_rejects(spark, sf):
    return stages.rejects(_first_pass(spark, sf)).select(
        "srs_id", "llm_provider", "llm_model", "reply_similarity_orig", "reply_similarity_dist"
    )


@query
def first_pass_chat(spark, sf):
    chat = _first_pass(spark, sf).select("srs_id", "llm_model", F.posexplode("chat").alias("pair", "said"))
    return chat.select("srs_id", "llm_model", F.col("pair").cast("long").alias("pair"), "said.user", "said.assistant")


@query
def batch_summary(spark, sf):
    return first_pass.batch_summary(_first_pass(spark, sf))


@query
def batch_of_ids(spark, sf):
    """The batch over listed documents, its answers from the function."""
    ask = stages.ask_function(digest_client(), spark.sparkContext.defaultParallelism)
    results = first_pass.batch(facade.corpus(spark, sf), ask, LISTED_IDS, facade.MODELS, 0.5)
    return first_pass.batch_summary(results)


@query
def generate_only(spark, sf):
    rows = facade.replies(spark, sf).select(
        F.lit("pA").alias("llm_provider"), F.lit("m0").alias("llm_model"),
        F.lit(0.5).alias("temperature"), "text", F.col("script_reply").alias("response"),
    )
    both = single_flow.generate_only(rows, "orig").unionByName(single_flow.generate_only(rows, "dist"))
    return both.select(
        "event_type", "llm_provider", "llm_model", "temperature", "original_srs_text",
        "distilled_srs_text", "plantuml_script_orig_srs", "plantuml_script_dist_srs",
    )


@query
def distil_only(spark, sf):
    rows = facade.replies(spark, sf).select(
        F.lit("pA").alias("llm_provider"), F.lit("m0").alias("llm_model"),
        F.lit(0.5).alias("temperature"), "text", F.col("reply").alias("response"),
    )
    return single_flow.distil_only(rows).select(
        "event_type", "llm_provider", "llm_model", "temperature", "original_srs_text",
        "distilled_srs_text", "srs_id",
    )


@query
def similarity_only(spark, sf):
    rows = facade.replies(spark, sf).select(
        F.lit("pA").alias("llm_provider"), F.lit("m0").alias("llm_model"),
        F.lit(0.5).alias("temperature"), "text",
        txt.extract_script(F.col("script_reply")).alias("script"), F.col("reply").alias("response"),
    )
    return single_flow.similarity_only(rows, "dist").select(
        "event_type", "temperature", "distilled_srs_text", "plantuml_script_dist_srs",
        "similarity_descr_dist_srs", "similarity_descr_orig_srs",
    )


@query
def render_only(spark, sf):
    rows = facade.replies(spark, sf).select(
        txt.extract_script(F.col("script_reply")).alias("script"),
        F.col("reply").cast("binary").alias("image"),
    )
    return single_flow.render_only(rows, "orig").select(
        "event_type", "llm_provider", "plantuml_script_orig_srs",
        F.md5("uml_image_data_orig_srs").alias("image_md5"),
    )


@query
def backfeed_work(spark, sf):
    return backfeed.work_list(
        facade.requested_keys(spark, sf), facade.run_log(spark, sf), facade.MODELS
    ).drop("lookup_error")


@query
def backfeed_results(spark, sf):
    results = backfeed.backfeed_recorded(
        facade.requested_keys(spark, sf),
        facade.run_log(spark, sf),
        facade.backfeed_responses(spark, sf),
        facade.MODELS,
    )
    return results.select(
        "srs_id", "llm_provider", "llm_model", "temperature", "event_type", "original_srs_text",
        "distilled_srs_text", "plantuml_script_orig_srs", "plantuml_script_dist_srs",
        "similarity_score_orig_srs", "similarity_descr_orig_srs", "similarity_descr_dist_srs",
        "state_orig", "state_dist",
    )


def digest_client():
    """A stand-in for a model client: its answer depends on the whole prompt alone."""

    def make_client():
        def answer(prompt: str, api_id: str, temperature: float) -> str:
            digest = hashlib.md5(prompt.encode()).hexdigest()
            if "similarity_score" in prompt:
                return f'{{"similarity_score": {len(prompt)}, "discrepancies": ["{digest}"]}}'
            if "First line: @startuml" in prompt:
                return f"@startuml\n' {digest}\n@enduml"
            return f"{api_id} {temperature} {digest}"

        return answer

    return make_client


def _spread_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document once per model, in as many tasks as the texts need."""
    docs = facade.batch_documents(spark, sf)
    tasks = completion.tasks_for(docs, "srs_content", least=spark.sparkContext.defaultParallelism)
    return catalog.fan_out(docs, facade.MODELS, 0.5, tasks)


@query
def completion_map(spark, sf):
    runs = _spread_runs(spark, sf)
    asked = completion.complete(
        runs, {"distil": prompts.distil(F.col("original_srs_text"))}, digest_client()
    )
    return asked.select("srs_id", "llm_model", F.col("reply_distil").alias("response"))


@query
def first_pass_completed(spark, sf):
    """First pass with the function instead of recorded answers."""
    results = first_pass.first_pass(_spread_runs(spark, sf), stages.ask_function(digest_client()))
    return results.select(
        "srs_id", "llm_provider", "llm_model", "temperature", "plantuml_script_orig_srs",
        "distilled_srs_text", "plantuml_script_dist_srs", "similarity_score_orig_srs",
        "similarity_score_dist_srs", "similarity_descr_orig_srs", "state_orig", "state_dist",
    )


def _ask_for_runs(spark: SparkSession, sf: str) -> stages.Ask:
    """The function, asked in as many tasks as the texts of the run log need; a back-feed has no more."""
    texts = ("original_srs_text", "distilled_srs_text")
    tasks = completion.tasks_for(facade.run_log(spark, sf), *texts, least=spark.sparkContext.defaultParallelism)
    return stages.ask_function(digest_client(), tasks)


@query
def backfeed_completed(spark, sf):
    """Back-feed with the function instead of recorded answers."""
    work = backfeed.work_list(
        facade.requested_keys(spark, sf), facade.run_log(spark, sf), facade.MODELS
    )
    ask = _ask_for_runs(spark, sf)
    return backfeed.backfeed(work, ask).select(
        "srs_id", "llm_provider", "llm_model", "temperature", "event_type",
        "plantuml_script_orig_srs", "plantuml_script_dist_srs", "similarity_score_orig_srs",
        "similarity_descr_orig_srs", "state_orig", "state_dist",
    )


def busy_client():
    """A stand-in for a client that fails as often as the digest of the prompt says, at most three times."""

    def make_client():
        # By digest: the prompts of a task would stay in memory.
        tried: dict[bytes, int] = {}

        def answer(prompt: str, api_id: str, temperature: float) -> str:
            digest = hashlib.md5(prompt.encode()).hexdigest()
            key = bytes.fromhex(digest)
            tried[key] = tried.get(key, 0) + 1
            if tried[key] <= int(digest[0], 16) % 4:
                raise ValueError("busy")
            return f"{api_id} {temperature} {digest}"

        return answer

    return make_client


def _asked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return facade.documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.lit("pA").alias("llm_provider"), F.lit("api-m0").alias("api_id"),
        F.lit(0.5).alias("temperature"), "text",
    )


@query
def completion_retried(spark, sf):
    """Documents asked for by number, in pools of calls that fail at first."""
    prompt = F.concat("id", F.lit(": "), "text")
    rows = _asked_documents(spark, sf)
    tasks = completion.tasks_for(rows, "text", least=spark.sparkContext.defaultParallelism)
    found = calls.complete_retried(rows, prompt, busy_client(), backoff=0.001, calls=tasks)
    return found.select("id", "reply", "attempts")


@query
def completion_once(spark, sf):
    """Documents asked for in two runs: copies share a call, and the second run calls for new texts only."""
    folder = new_folder(spark, "answers")
    rows = _asked_documents(spark, sf)
    tasks = completion.tasks_for(rows, "text", least=spark.sparkContext.defaultParallelism)

    def ask(rows: DataFrame, prompt) -> DataFrame:
        return calls.complete_retried(rows, prompt, digest_client(), calls=tasks)

    calls.complete_once(rows.where("id % 2 = 0"), F.col("text"), "id", folder, ask)
    return calls.complete_once(rows, F.col("text"), "id", folder, ask).select("id", "reply", "called")


@query
def backfeed_until_accepted(spark, sf):
    """Back-feed until the digest among the findings begins with one of six digits, at most five rounds."""
    work = backfeed.work_list(
        facade.requested_keys(spark, sf), facade.run_log(spark, sf), facade.MODELS
    )
    ask = _ask_for_runs(spark, sf)
    begin = F.substring("similarity_descr_orig_srs", len("discrepancies:\n") + 1, 1)
    rows = accept.backfeed_until(work, ask, begin < "6", 5)
    return rows.select(
        "srs_id", "llm_provider", "llm_model", "temperature", "rounds", "verdict", "run_count", "event_type",
        "plantuml_script_orig_srs", "plantuml_script_dist_srs", "similarity_descr_orig_srs",
        "similarity_score_dist_srs",
    )


# --- streams ------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; the pattern matches one file as well as a folder of files."""
    schema = facade.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query
def stream_latest(spark, sf):
    events = _stream(spark, sf, "events").selectExpr(
        "event_id as id", "cast(user_id as string) as srs_id",
        "if(event_id % 5 < 3, 'pA', 'pB') as llm_provider", "concat('m', event_id % 5) as llm_model",
        "(event_id % 2) * 0.5D as temperature", "cast(ts as timestamp) as created_at",
    )
    return run_stream.current(
        spark, events, new_folder(spark, "runs"), new_folder(spark, "runs-state")
    )


@query
def stream_responses(spark, sf):
    rows = _stream(spark, sf, "conversations").selectExpr(
        "conv_id as request_id", "turn as seq", "text as chunk"
    )
    return reply_stream.assemble(
        spark, rows, new_folder(spark, "replies"), new_folder(spark, "replies-state")
    )


def arrivals(rows: list[DataFrame], folder: str, files: int) -> DataFrame:
    """The tables as a stream that brings them one after the other, each in a micro-batch of its own."""
    for part in rows:
        part.repartition(files).write.mode("append").parquet(folder)
    spark = rows[0].sparkSession
    return spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


@query
def stream_running(spark, sf):
    """Replies whose chunks come in three parts, the first ones last."""
    said = facade.chunks(spark, sf)
    lasts = said.groupBy("request_id").agg(F.max("seq").alias("_last"))
    marked = said.join(lasts, "request_id").select(
        "request_id", "seq", "chunk", (F.col("seq") == F.col("_last")).alias("last"),
        F.timestamp_seconds("seq").alias("at"),
    )
    parts = [marked.where(F.col("seq") % 3 == k) for k in (2, 1, 0)]
    rows = arrivals(parts, new_folder(spark, "chunks"), spark.sparkContext.defaultParallelism)
    shown = running.running(rows, "3650 days")
    folder = new_folder(spark, "running")
    sinks.start(shown, "append", folder, new_folder(spark, "running-state")).awaitTermination()
    return corpus_stream.inserted(spark, shown.schema, folder)


@query
def stream_matched(spark, sf):
    """Even events ask, odd ones reply to the event before; some replies take too long, some fail."""
    events = facade.table(spark, sf, "events")
    at = F.col("ts").cast("timestamp")
    requests = events.where("event_id % 2 = 0").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("stage"), at.alias("asked_at")
    )
    late = F.make_dt_interval(mins=F.col("value").cast("int"))
    replies = events.where("event_id % 2 = 1 and event_type <> 'error'").select(
        (F.col("event_id") - 1).alias("request_id"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("[Error] "), "props")).otherwise(F.col("props")).alias("response"),
        (at + late).alias("replied_at"),
    )
    files = spark.sparkContext.defaultParallelism
    # A last row of its own id moves the clock of each stream on, so that open requests come out.
    end = events.agg(F.max(at) + F.expr("interval 90 days"))
    asked = arrivals(
        [requests.where("request_id % 4 = 0"), requests.where("request_id % 4 = 2"),
         end.selectExpr("-1L", "cast(null as string)", "*").toDF(*requests.columns)],
        new_folder(spark, "asked"), files,
    )
    replied = arrivals(
        [replies.where("request_id % 3 = 0"), replies.where("request_id % 3 > 0"),
         end.selectExpr("-2L", "cast(null as string)", "*").toDF(*replies.columns)],
        new_folder(spark, "replied"), files,
    )
    matched = matching.match_streams(asked, replied, "30 minutes", "60 days").drop("asked_at", "replied_at")
    folder = new_folder(spark, "matched")
    sinks.start(matched, "append", folder, new_folder(spark, "matched-state")).awaitTermination()
    return corpus_stream.inserted(spark, matched.schema, folder)


def _stream_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, "documents").selectExpr(
        "doc_id as id",
        "source as srs_origin",
        "if(n_chars >= 200, lang, null) as srs_title",
        "text as srs_content",
    )


@query
def stream_insert(spark, sf):
    rows, folder = _stream_triples(spark, sf), new_folder(spark, "inserted")
    corpus_stream.insert_stream(
        rows, "id", folder, new_folder(spark, "inserted-state"), facade.labelled_triples(spark, sf)
    ).awaitTermination()
    return corpus_stream.inserted(spark, rows.schema, folder)


@query
def stream_insert_indexed(spark, sf):
    """The same rows with an index of digests, over several micro-batches."""
    documents = facade.triples(spark, sf)
    parts = [documents.where(F.col("id") % 3 == k) for k in range(3)]
    rows = arrivals(parts, new_folder(spark, "entries"), spark.sparkContext.defaultParallelism)
    folder = new_folder(spark, "inserted")
    digest_index.insert_indexed(
        rows, "id", folder, new_folder(spark, "index"), new_folder(spark, "inserted-state"), facade.labelled_triples(spark, sf)
    ).awaitTermination()
    # Which of several copies came first depends on the order of arrival.
    return corpus_stream.inserted(spark, rows.schema, folder).drop("id")


@query
def stream_unseen(spark, sf):
    rows = corpus_stream.unseen(_stream_triples(spark, sf), "id")
    folder = new_folder(spark, "unseen")
    sinks.start(rows, "append", folder, new_folder(spark, "unseen-state")).awaitTermination()
    return corpus_stream.inserted(spark, rows.schema, folder).drop("id")


@query
def stream_unseen_within(spark, sf):
    """Events without repeats of user, type and value; all come within the delay."""
    events = _stream(spark, sf, "events").selectExpr(
        "event_id as id",
        "cast(user_id as string) as srs_origin",
        "event_type as srs_title",
        "cast(cast(value as long) as string) as srs_content",
        "cast(ts as timestamp) as at",
    )
    rows = corpus_stream.unseen_within(events, "id", "at", "3650 days")
    folder = new_folder(spark, "within")
    sinks.start(rows, "append", folder, new_folder(spark, "within-state")).awaitTermination()
    return corpus_stream.inserted(spark, rows.schema, folder).drop("id", "at")


@query
def chunk_offsets_sparse(spark, sf):
    """Sequence numbers with wide gaps, as time stamps leave them."""
    sparse = facade.chunks(spark, sf).withColumn("seq", F.col("seq") * 5000 + 17)
    return chunks.chunk_offsets(sparse)
