"""The registered queries: every operator of the library on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import clustered, encode, incremental, reports, requests, search, store
from codeloom.operators.extract import chunks, rejects
from codeloom.operators.lines import by_path, line_facts, line_model
from codeloom.operators.patterns import of_language
from codeloom.plans.corpus import modules
from codeloom.plans.index import ask, index_files, question
from codeloom.session import shared_folder
from codeloom.sources.requests import stream_requests
from codeloom.streaming import changes, index_stream

Query = Callable[[SparkSession, str], DataFrame]

SUFFIXES = (".py", ".go", ".js", ".ts", ".tsx", ".rs", ".txt", "")
TREE_SKIPPED = ("fr", "spam")
TREE_EXTENSIONS = ("", ".html")
FOOTPRINT_NAMES = ("en/src1", "fr", "de/src10", "src7", "absent/model")
QUESTIONS = (("q1", ("price", "12")), ("q2", ("quote", "1")), ("q3", ("Catalog3", "prices", "of", "block")), ("q4", ("area", "77", "size")))
KIND_LANGUAGES = {"go": "go", "js": "javascript", "ts": "typescript", "tsx": "typescript", "rust": "rust"}
TURNS_PER_REQUEST = 4
REQUESTS_PER_SESSION = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for written tables, below the one the cluster names."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# --- paths and files -------------------------------------------------------------


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*/", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_paths(spark, sf_dir).withColumn("extension", X.extension(F.col("path")))
    return rows.where(
        F.col("extension").isin(*TREE_EXTENSIONS) & ~X.in_skipped_directory(F.col("path"), TREE_SKIPPED)
    )


def extension_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_paths(spark, sf_dir).withColumn("extension", X.extension(F.col("path")))
    return store.as_set(rows, "extension")


def rotated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = F.array(*[F.lit(s) for s in SUFFIXES])
    key = F.col("p_partkey")
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/m"), key.cast("string"))
    return table(spark, sf_dir, "part").select(
        F.concat(name, suffixes[(key % len(SUFFIXES)).cast("int")]).alias("path")
    )


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotated_paths(spark, sf_dir)
    return rows.select("path", F.coalesce(X.detect_language(F.col("path")), F.lit("")).alias("language"))


def rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(rotated_paths(spark, sf_dir))


# --- lines and chunks ------------------------------------------------------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_model(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return lines.select("doc_id", "ln", "ind", "blank", F.length("txt").alias("n_chars"), F.md5("txt").alias("txt_md5"))


def python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(table(spark, sf_dir, "part"), "python")


def code_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = line_facts(by_path(python_modules(spark, sf_dir), ["python"]), ["python"])
    return facts.select("path", "ln", "in_string", F.col("depth").cast("int").alias("depth"), "code_end")


def python_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(python_modules(spark, sf_dir))


def python_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(python_modules(spark, sf_dir), "declared", of_language("python"))


def brace_chunks(kind: str, arrows: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = modules(table(spark, sf_dir, "part"), kind)
        return chunks(files, "declared", of_language(KIND_LANGUAGES[kind]), arrows)

    return run


def brace_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In effective mode a mixed tree only yields the chunks of its Python files."""
    part = table(spark, sf_dir, "part")
    mixed = modules(part, "python").unionByName(modules(part, "go")).unionByName(modules(part, "rust"))
    return chunks(mixed).select("id", "language", "chunk_type", F.md5("content").alias("content_md5"))


def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON line of every file, read back and listed field by field."""
    lines = requests.request_lines(python_chunks(spark, sf_dir))
    fields = "file_path string, function_name string, class_name string, start_line int, end_line int, language string, chunk_type string"
    read = F.from_json("value", f"chunks array<struct<id string, content string, metadata struct<{fields}>>>")
    written = F.transform(
        read["chunks"],
        lambda c: F.concat_ws(
            "|", c["id"], F.md5(c["content"]), *[c["metadata"][field.split()[0]] for field in fields.split(", ")]
        ),
    )
    return lines.select(
        "file_path",
        "n_chunks",
        F.array_join("chunk_ids", ",").alias("chunk_ids"),
        F.array_join(written, ",").alias("request"),
    )


# --- requests --------------------------------------------------------------------


def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in groups of at most ``TURNS_PER_REQUEST``."""
    rows = table(spark, sf_dir, "conversations")
    chunk = F.struct(
        F.format_string("c%d_%d", "conv_id", "turn").alias("id"),
        F.col("text").alias("content"),
        F.struct("role").alias("metadata"),
    )
    return rows.groupBy("conv_id", F.floor(F.col("turn") / TURNS_PER_REQUEST).alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("turn", chunk.alias("chunk")))).getField("chunk").alias("chunks")
    )


def request_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session texts: good requests and every kind of broken one, chosen by a rule on the keys."""
    rows = turn_chunks(spark, sf_dir)
    rule = (F.col("conv_id") + F.col("blk")) % 9
    meta = F.struct(F.format_string("req-%d-%d", "conv_id", "blk").alias("id"))
    first = F.col("chunks")[0]
    dropped = F.transform(F.slice("chunks", 1, 1), lambda c: c.withField("content", F.lit(None).cast("string")))
    as_json = lambda chunk_list: F.to_json(F.struct(meta.alias("meta"), chunk_list.alias("chunks")))
    good = as_json(F.col("chunks"))
    value = (
        F.when(rule == 1, F.to_json(F.struct("chunks")))
        .when(rule == 2, good.substr(F.lit(1), F.length(good) - 2))
        .when(rule == 3, as_json(F.slice("chunks", 1, 0)))
        .when(rule == 4, F.concat(F.lit('{"meta":null,'), F.to_json(F.struct("chunks")).substr(F.lit(2), F.lit(1 << 30))))
        .when(rule == 5, as_json(F.concat(F.col("chunks"), dropped)))
        .when(rule == 6, as_json(F.concat(F.col("chunks"), F.array(first))))
        .when(rule == 7, F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(good)
    )
    lines = rows.select("conv_id", "blk", value.alias("value"))
    session = F.floor(F.col("blk") / REQUESTS_PER_SESSION)
    ended = F.when(
        (F.col("conv_id") % 5 == 0) & (F.col("blk") % REQUESTS_PER_SESSION == 0), F.concat("value", F.lit("\n exit \t"))
    ).otherwise(F.col("value"))
    grouped = lines.groupBy("conv_id", session.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("blk", ended.alias("line")))).getField("line").alias("lines")
    )
    return grouped.select(
        F.format_string("s%d-%d", "conv_id", "part").alias("session"),
        F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("text"),
    )


def session_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.acks(requests.parsed(requests.session_lines(request_sessions(spark, sf_dir))))


def request_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session_acks(spark, sf_dir)
    return rows.select(
        "session",
        F.col("line_no").cast("int").alias("line_no"),
        F.when(F.col("generated_id"), "generated").otherwise(F.col("id")).alias("id"),
        "status",
        F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("indexed_count", F.lit(-1)).alias("indexed_count"),
    )


def ack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.ack_summary(session_acks(spark, sf_dir))
    return rows.select("status", "requests", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_report(request_sessions(spark, sf_dir), session_acks(spark, sf_dir))


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sends of all conversation turns over one checkpoint: all, the same again, assistants' turns edited.

    Keyed state by (conv_id, turn): the replay writes nothing, the edit writes the rows of the edited keys.
    """
    root = fresh_folder(spark, "changes")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    edited = turns.withColumn(
        "text", F.when(F.col("role") == "assistant", F.concat(F.lit("again: "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    )
    schema = turns.withColumn("sent", F.lit(0)).schema

    for sent, rows in ((1, turns), (2, turns), (3, edited)):
        rows.withColumn("sent", F.lit(sent)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        found = changes.changed(stream, ["conv_id", "turn"], changes.row_digest("role", "text"))
        query = (
            found.writeStream.format("parquet")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{root}/out")
        )
        query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("sent", "conv_id", "turn", "role", "text", "digest")


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the stream over one checkpoint; the second replaces what assistants said."""
    root = fresh_folder(spark, "stream")
    rows = turn_chunks(spark, sf_dir)
    collection = store.Collection(spark, f"{root}/store", index_stream.COLLECTION)

    def send(lines: DataFrame, mode: str) -> None:
        lines.write.mode(mode).text(f"{root}/in")
        stream = index_stream.start(
            stream_requests(spark, f"{root}/in"), collection, f"{root}/checkpoint", f"{root}/acks", available_now=True
        )
        stream.awaitTermination()

    send(rows.select(F.to_json(F.struct("chunks")).alias("value")), "overwrite")
    spoken = F.filter("chunks", lambda c: c["metadata"]["role"] == "assistant")
    replaced = F.transform(spoken, lambda c: c.withField("content", F.concat(F.lit("again: "), c["content"])))
    send(rows.select(F.to_json(F.struct(replaced.alias("chunks"))).alias("value")), "append")
    return collection.rows().select("id", F.md5("document").alias("document_md5"), F.col("metadata.role").alias("role"))


# --- keyed tables ----------------------------------------------------------------


def document_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and the ones that were labelled later with their label in the text."""
    documents = table(spark, sf_dir, "documents")
    base = documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), F.lit(1).alias("batch_seq"), F.lit(0).alias("position")
    )
    later = documents.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.format_string("%s [quality %d]", "text", "quality").alias("document"),
        F.lit(2).alias("batch_seq"),
        F.lit(0).alias("position"),
    )
    return base, later


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.md5("document").alias("document_md5"), "batch_seq")


def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, later = document_batches(spark, sf_dir)
    return _digest(store.upserted(base, later))


def collection_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, later = document_batches(spark, sf_dir)
    return _digest(store.added(later, base))


def set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return store.members(documents, table(spark, sf_dir, "labels"), "doc_id")


def set_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return store.without(documents, table(spark, sf_dir, "labels"), "doc_id")


def collection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.collection_report(table(spark, sf_dir, "documents"), "source")


def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("models--"), "lang", F.lit("--"), "source").alias("directory"), F.col("n_chars").alias("length")
    )
    rows = reports.footprint(entries, FOOTPRINT_NAMES)
    return rows.select("name", F.round("megabytes", 6).alias("megabytes"))


# --- incremental refresh ----------------------------------------------------------


def documents_and_manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and an older manifest: only labelled ones were there, toxic ones with other text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    older = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    then = documents.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", older.alias("text"))
    return documents, incremental.manifest_of(then, "doc_id", "text")


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents, manifest = documents_and_manifest(spark, sf_dir)
    return incremental.with_change(documents, manifest, "doc_id", "text").drop("text"), manifest


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)[0].select("doc_id", "sha256", "changed")


def group_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)[0]
    return incremental.refresh_groups(changes, "source").select("doc_id", "source", "changed")


def manifest_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, manifest = _changes(spark, sf_dir)
    return incremental.refreshed_manifest(manifest, changes.where("changed"), "doc_id")


def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text gets a byte that is not UTF-8; reading replaces it."""
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("09FF")), F.encode(F.lit(" end"), "UTF-8"))
    repaired = X.repaired_text(broken)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalized(repaired)).alias("text_md5"))


# --- search ----------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir)
    query = corpus.where("id = 0").select("embedding").scalar()
    return search.nearest_to(corpus, query, 50)


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks for its neighbours."""
    asked = vectors(spark, sf_dir).withColumnRenamed("id", "query_id")
    return search.nearest(vectors(spark, sf_dir), asked, 50)


def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hits(vectors(spark, sf_dir), probes(spark, sf_dir), search.THRESHOLD)
    return found.select("query_id", "rank", "id", "distance", F.round("similarity", 6).alias("similarity"))


def knn_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold that many rows pass, so that the cut at five matters."""
    found = search.hits(vectors(spark, sf_dir), probes(spark, sf_dir), 1.9)
    return found.select("query_id", "rank", "id", "distance", F.round("similarity", 6).alias("similarity"))


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector asks for 50 neighbours in a clustered index (k-means cells, probed cells only)."""
    return clustered.clustered_nearest(vectors(spark, sf_dir), probes(spark, sf_dir), 50)


def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.approximately_nearest(vectors(spark, sf_dir), probes(spark, sf_dir), 50)


def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.encoded(table(spark, sf_dir, "documents"), "doc_id", "text")
    return encode.as_postings(rows, "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    corpus = encode.encoded(documents, "doc_id", "text").withColumnRenamed("doc_id", "id")
    queries = encode.encoded(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    found = search.hits(corpus, queries)
    return found.select("query_id", "rank", "id", "distance", F.round("similarity", 6).alias("similarity"))


def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index the Python modules into a collection and ask four questions of it."""
    collection = store.Collection(spark, fresh_folder(spark, "search"), index_stream.COLLECTION)
    index_files(python_modules(spark, sf_dir), collection)
    asked = spark.createDataFrame(QUESTIONS, "query_id string, words array<string>")
    queries = asked.select("query_id", question(F.col("words")).alias("text"))
    found = ask(collection.rows(), queries)
    return found.select(
        "query_id", "rank", "id", "document", "distance", F.round("similarity", 6).alias("similarity")
    )


QUERIES: dict[str, Query] = {
    "tree_filter": tree_filter,
    "extension_set": extension_set,
    "detect_language": detect_language,
    "rejected_files": rejected_files,
    "line_model": document_lines,
    "code_mask": code_mask,
    "py_chunks": python_chunks,
    "py_declared": python_declared,
    "brace_go": brace_chunks("go"),
    "brace_js": brace_chunks("js"),
    "brace_ts": brace_chunks("ts"),
    "brace_tsx": brace_chunks("tsx"),
    "brace_rust": brace_chunks("rust"),
    "brace_ts_arrows": brace_chunks("ts", arrows=True),
    "mixed_effective": brace_effective,
    "chunk_requests": chunk_requests,
    "request_acks": request_acks,
    "ack_summary": ack_summary,
    "run_report": run_report,
    "stream_index": stream_index,
    "collection_upsert": collection_upsert,
    "collection_add": collection_add,
    "set_members": set_members,
    "set_remove": set_remove,
    "collection_report": collection_report,
    "footprint": footprint,
    "changed_files": changed_files,
    "group_refresh": group_refresh,
    "manifest_refresh": manifest_refresh,
    "normalize_ws": normalize_ws,
    "knn_exact": knn_exact,
    "knn_batch": knn_batch,
    "knn_threshold": knn_threshold,
    "knn_wide": knn_wide,
    "knn_lsh": knn_lsh,
    "knn_ivf": knn_ivf,
    "stream_changes": stream_changes,
    "encode_text": encode_text,
    "search_text": search_text,
    "search_chunks": search_chunks,
}
