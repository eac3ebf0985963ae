"""Sources and sinks as queries: tables are written to the shared folder and read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..operators import catalog
from ..session import materialise, shared_folder
from ..sources import sinks, specs, tables
from .registry import Tables, query

EVENT = "event_id long, user_id string, event_type string, value double"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _event_lines(spark: SparkSession, sf_dir: str, damaged: int = 0) -> str:
    """The events as JSON lines with blank lines among them; every ``damaged``-th is cut off."""
    path = _folder(spark, "lines")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    if damaged:
        line = F.when(F.col("event_id") % damaged == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    blank = F.when(F.col("event_id") % 10 == 0, F.lit("\n  ")).otherwise("")
    Tables(spark, sf_dir).events.select(F.concat(line, blank).alias("value")).write.text(path)
    return path


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(user_id::VARCHAR) AS last_user, max(value) AS top FROM events GROUP BY event_type")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines over all shards, numbers read into the types of the schema; blank lines never count."""
    rows = tables.read_jsonl(spark, _event_lines(spark, sf_dir) + "/part-*", EVENT)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("user_id").alias("last_user"), F.max("value").alias("top"))


@query("SELECT count(*) AS n_lines, count_if(event_id % 50 = 0)::BIGINT AS n_bad, count_if(event_id % 50 <> 0)::BIGINT AS n_kept, count(*) AS n_all FROM events")
def jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are cut off: counted, left out, and kept beside the good ones."""
    path = _event_lines(spark, sf_dir, 50)
    good = tables.read_jsonl(spark, path, EVENT).agg(F.count(F.lit(1)).alias("n_kept"))
    every = tables.read_jsonl(spark, path, EVENT, "keep").agg(F.count(F.coalesce("bad_line", F.col("event_id").cast("string"))).alias("n_all"))
    return tables.bad_line_count(spark, path).join(good, F.lit(True)).join(every, F.lit(True))


@query("SELECT event_type AS bucket, event_type AS label, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def bucket_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder a label; read back over several files, each row with the file that it came from."""
    path = _folder(spark, "buckets")
    events = Tables(spark, sf_dir).events
    sinks.save_buckets(events.select("event_id", F.col("event_type").alias("bucket"), F.col("event_type").alias("label")), path, "bucket")
    rows = tables.read_jsonl(spark, f"{path}/*", "event_id long, label string")
    return rows.groupBy(F.regexp_extract("file", "bucket=([^/]+)/", 1).alias("bucket"), "label").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT r_regionkey AS no, r_name AS name, length(line) AS size_bytes, sha256(line) AS sha256 FROM (
        SELECT *, '{"no":' || r_regionkey || ',"name":"' || r_name || '"}' || chr(10) AS line FROM region)""")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a file, with the digest and size of its bytes."""
    return _region_files(spark, sf_dir).select("no", "name", "size_bytes", "sha256")


def _region_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "documents")
    region = Tables(spark, sf_dir).region
    region.select(F.col("r_regionkey").alias("no"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("p")).repartition("p").write.partitionBy("p").json(path)
    return tables.read_documents(spark, f"{path}/*/*.json", "no long, name string")


@query("""SELECT count(*) AS n_files, sum(length(line))::BIGINT AS size_bytes, sha256(string_agg(sha256(line), '' ORDER BY r_regionkey)) AS sha256 FROM (
        SELECT *, '{"no":' || r_regionkey || ',"name":"' || r_name || '"}' || chr(10) AS line FROM region)""")
def input_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and one digest of a directory of inputs, in order of name."""
    return tables.corpus_digest(_region_files(spark, sf_dir))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key wins."""
    return tables.last_per_key(Tables(spark, sf_dir).events, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was asked for and has no label yet."""
    t = Tables(spark, sf_dir)
    return tables.pending(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.role = 'assistant')")
def pending_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a key of two columns."""
    turns = Tables(spark, sf_dir).conversations
    return tables.pending(turns.select("conv_id", "turn"), turns.filter("role = 'assistant'"), ["conv_id", "turn"])


_MESSAGES = "SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role, text AS content, 'chat' || conv_id % 3 AS chat_id FROM conversations"


def _messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = Tables(spark, sf_dir).conversations
    messages = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"))
    return messages, turns.select(F.col("conv_id").alias("id"), F.concat(F.lit("chat"), (F.col("conv_id") % 3).cast("string")).alias("chat_id")).distinct()


@query(f"SELECT id, session_id, chat_id, content FROM ({_MESSAGES}) WHERE role = 'user' AND chat_id IN ('chat0', 'chat2') AND id > 5000")
def messages_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages of some chats beyond a mark, joined to their sessions."""
    messages, sessions = _messages(spark, sf_dir)
    return tables.new_messages(messages, sessions, ["chat0", "chat2"], 5_000).select("id", "session_id", "chat_id", "content")


@query(f"SELECT max(id) AS mark FROM ({_MESSAGES}) WHERE role = 'user'")
def message_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.high_water_mark(_messages(spark, sf_dir)[0])


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderstatus")
def checked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool with one row a key, cut to a key list that it must cover."""
    t = Tables(spark, sf_dir)
    keys = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    pool = tables.require_complete(tables.require_unique(t.orders, ["o_orderkey"]), keys, ["o_orderkey"])
    return pool.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT n_nationkey, n_name, n_regionkey, f AS format, 'Nations' AS title, 'nations.' || s AS name
        FROM nation, (VALUES ('parquet', 'parquet'), ('json', 'jsonl'), ('csv', 'csv'), ('csv', 'tsv'), ('orc', 'orc')) AS v(f, s)""")
def saved_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled table in every format, read back beside the record that was written with it."""
    nation = Tables(spark, sf_dir).nation.select("n_nationkey", "n_name", "n_regionkey")
    out = None
    for suffix in ("parquet", "jsonl", "csv", "tsv", "orc"):
        path = f"{_folder(spark, 'artifact')}/nations.{suffix}"
        sinks.save(nation, path, title="Nations", description="All nations.", tags=["geo"])
        reader = spark.read.schema(nation.schema).option("header", True).option("sep", "\t" if suffix == "tsv" else ",")
        card = spark.read.text(path + ".meta").select(*(J.path_value(F.col("value"), k).alias(k) for k in ("format", "title", "name")))
        rows = reader.format(sinks.format_of(path)).load(path).join(card, F.lit(True))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT p_name || p_partkey AS path, CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS title, 'first' AS created_at, p_size > 25 AS saved_again FROM part""")
def artifact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts saved again: labels that are left out are inherited, the time of the first save stays."""
    part = Tables(spark, sf_dir).part
    path = F.concat("p_name", F.col("p_partkey").cast("string")).alias("path")
    rest = [F.lit(None).cast("string").alias(c) for c in ("description", "tags", "caveats", "sensitivity", "format")]
    first = part.select(path, F.col("p_brand").alias("title"), *rest, F.lit("first").alias("created_at"), F.lit(False).alias("saved_again"))
    again = part.filter("p_size > 25").select(path, F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("title"), *rest, F.lit("second").alias("created_at"), F.lit(True).alias("saved_again"))
    return catalog.upsert_artifacts(first, again).select("path", "title", "created_at", "saved_again")


@query("SELECT o_orderkey AS step, unnest(['price', 'custkey']) AS key, unnest([o_totalprice, o_custkey::DOUBLE]) AS value FROM orders")
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metric rows as long ones, appended twice: what is there is not appended again, so a run can be resumed."""
    path = _folder(spark, "metrics")
    rows = sinks.metric_rows(Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("custkey")), "step")
    rows.filter("key = 'price'").write.parquet(path)
    for _ in range(2):
        new = materialise(sinks.append_new(rows, spark.read.schema(rows.schema).parquet(path), ["step", "key"]), "new")
        new.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT conv_id, role AS label FROM conversations GROUP BY conv_id, role")
def annotation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array labels as a table of their own: a row for each key and label."""
    parents = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.collect_list("role").alias("roles"), F.count(F.lit(1)).alias("n"))
    return sinks.normalised_annotations(parents, "conv_id", {"roles": "roles"})["roles"]


@query("""SELECT side, lang, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT)::DECIMAL(38, 0) AS id_digest
        FROM (SELECT *, CASE WHEN n_chars < 600 THEN 'train' ELSE 'eval' END AS side FROM documents) GROUP BY side, lang""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, ends and digest of the ids of each side and family of a split."""
    docs = Tables(spark, sf_dir).documents.withColumn("side", F.when(F.col("n_chars") < 600, "train").otherwise("eval"))
    return sinks.split_manifest(docs, "side", "lang", "doc_id")


@query("SELECT s_suppkey, s_name, 'rank' AS stage FROM supplier WHERE s_acctbal > 1000")
def chained_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage whose specification names the artifact of an earlier run as its input."""
    root = _folder(spark, "runs")
    sinks.save(Tables(spark, sf_dir).supplier, f"{root}/first/suppliers.parquet", title="Suppliers", description="All of them.")
    spec = {"stage": "rank", "input_run": "first", "input_artifact": "suppliers", "least": 1000}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(f"{root}/spec")
    spec_file = spark.read.format("binaryFile").load(f"{root}/spec/*.txt").first().path
    moved = f"{root}/second.json"
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(spec_file)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).rename(place, hadoop.Path(moved))
    found = specs.read_spec(spark, moved)
    artifacts = spark.createDataFrame([("first", "suppliers", f"{root}/first/suppliers.parquet")], "run_id string, name string, path string")
    rows = specs.stage_input(spark, artifacts, found).filter(F.col("s_acctbal") > found["least"])
    return rows.select("s_suppkey", "s_name", F.lit(found["stage"]).alias("stage"))


@query("SELECT event_id, event_type, ts FROM events")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as text with Z, read back; values that JSON cannot hold are null."""
    path = _folder(spark, "times")
    events = Tables(spark, sf_dir).events
    events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at")).write.json(path)
    return spark.read.schema("event_id long, event_type string, at string").json(path).select("event_id", "event_type", J.timestamp(F.col("at")).alias("ts"))
