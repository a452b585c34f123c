"""Serving: requests and their checks, settings, background jobs with progress, the single-query search."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.operators import retrieval

# What a request may ask for.
LEAST_TOP, MOST_TOP = 1, 50
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- requests


def request_problem(text: Column, top: Column, least: Column) -> Column:
    """Why a request is refused, or null: a blank text, or a number out of its range; a null threshold asks for none."""
    blank = text.isNull() | (t.strip(text) == "")
    return (
        F.when(blank, "blank text").when(top.isNull() | ~top.between(LEAST_TOP, MOST_TOP), "top_k out of range")
        .when(F.isnan(least) | ~least.between(0.0, 1.0), "threshold out of range")
    )


def check_request(text: str | None, top: int = 5, least: float | None = None) -> None:
    """Raises ValueError for what request_problem refuses."""
    if text is None or not text.strip():
        raise ValueError("blank text")
    if not isinstance(top, int) or not LEAST_TOP <= top <= MOST_TOP:
        raise ValueError("top_k out of range")
    if least is not None and not 0.0 <= least <= 1.0:
        raise ValueError("threshold out of range")


def fetch_size(top: int, reranked: bool) -> int:
    """How many results are fetched: more than asked for, if they are to be put in a new order."""
    return max(2 * top, retrieval.DEEP) if reranked else top


@query(
    "pf7_request_problems",
    rf"""SELECT coalesce(CASE WHEN content IS NULL OR regexp_matches(content, '^[\s\p{{Z}}]*$') THEN 'blank text' WHEN length(title) % 60 NOT BETWEEN {LEAST_TOP} AND {MOST_TOP} THEN 'top_k out of range'
      WHEN (length(title) % 13) / 10e0 > 1 THEN 'threshold out of range' END, 'accepted') AS problem, count(*) AS requests FROM {m.NODES_SQL} GROUP BY ALL""",
)
def request_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Node contents as requests, with numbers derived from their titles, judged and counted."""
    n = m.nodes(spark, folder).select("content", F.length("title").alias("n"))
    problem = request_problem(F.col("content"), F.col("n") % 60, (F.col("n") % 13) / F.lit(10.0))
    return n.groupBy(F.coalesce(problem, F.lit("accepted")).alias("problem")).agg(F.count("*").alias("requests"))


def search(spark: SparkSession, folder: str, text: str, top: int = 5, least: float | None = None, rerank: bool = True) -> DataFrame:
    """(id, score, place, file_path, page) of one question: checked, searched by words with title boost, put in order again.

    The corpus is read with a filter on the question's words only; there is no index to load.
    """
    check_request(text, top, least)
    asked = spark.createDataFrame([(0, text)], "query_id long, text string").select("query_id", t.tokens("text").alias("words"))
    titles = m.chunks(spark, folder, "document_id").join(m.documents(spark, folder).select(F.col("doc_id").alias("document_id"), "file_path"), "document_id")
    found = retrieval.bm25(retrieval.corpus(spark, folder), asked, fetch_size(top, rerank), titles.select("id", "file_path"))
    if rerank:
        found = m.checkpoint(found)
        order = retrieval.rerank(found, m.texts_of(spark, folder, found), asked, top)
        found = order.join(found.select("id", "score"), "id").select("id", "score", "place")
    else:
        found = found.where(F.col("rank") <= top).select("id", "score", F.col("rank").alias("place"))
    if least is not None:
        found = found.where(F.col("score") >= least)
    return found.join(retrieval.found_rows(spark, folder).select("id", "file_path", "page"), "id").orderBy("place")


@query(
    "qx12_expanded",
    rf"""WITH s AS (SELECT doc_id, {retrieval._WORDS.format(retrieval._STEM_SQL)} AS words FROM documents), syn AS (SELECT DISTINCT words[1] AS word, words[2] AS synonym FROM s WHERE len(words) >= 2),
      q AS (SELECT doc_id AS query_id, words FROM s WHERE doc_id % {retrieval.QUERY_STEP} = 0), more AS (SELECT query_id, list_sort(list(DISTINCT synonym)) AS more FROM (SELECT query_id, unnest(words) AS word FROM q) JOIN syn USING (word) GROUP BY query_id)
      SELECT query_id, array_to_string(q.words, ' ') AS asked, len(list_distinct(coalesce(more, []) || q.words)) AS words FROM q LEFT JOIN more USING (query_id)""",
)
def expanded_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names as queries, each word with what follows it at the beginning of other names; a joined table in the place of a model."""
    words = m.documents(spark, folder).select(t.tokens(t.stem("file_path")).alias("w")).where(F.size("w") >= 2)
    synonyms = words.select(F.element_at("w", 1).alias("word"), F.element_at("w", 2).alias("synonym")).distinct()
    asked = retrieval.stem_queries(spark, folder)
    wide = retrieval.expand(asked, synonyms).withColumnRenamed("words", "wide")
    return asked.join(wide, "query_id").select("query_id", F.array_join("words", " ").alias("asked"), F.size(F.array_distinct("wide")).cast("long").alias("words"))


# --- settings


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; unset values keep their defaults, unknown names are refused."""

    data_folder: str
    top: int = 5
    cache_size: int = 100
    debounce_seconds: float = 10.0
    files_per_trigger: int = 50
    max_retries: int = 3
    rerank: bool = True

    @staticmethod
    def load(environment: Mapping[str, str] = os.environ, file: str | None = None, prefix: str = "LOREWELL_") -> Settings:
        """From a JSON file, and over it from environment variables; the data folder must be set."""
        values: dict = {}
        if file:
            with open(file, encoding="utf-8") as f:
                values = json.load(f)
        known = {f.name: f.type for f in fields(Settings)}
        if unknown := set(values) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        for name in known:
            if prefix + name.upper() in environment:
                values[name] = environment[prefix + name.upper()]
        if not values.get("data_folder"):
            raise ValueError(f"{prefix}DATA_FOLDER must be set")
        to = {"int": int, "float": float, "str": str, "bool": lambda v: v if isinstance(v, bool) else str(v).strip().lower() in ("1", "true", "yes", "on")}
        return Settings(**{name: to[known[name]](value) for name, value in values.items()})


# --- background jobs


class Jobs:
    """Actions that run beside the caller, each in its own job group, with their progress in tasks."""

    def __init__(self, spark: SparkSession):
        self.spark, self._jobs, self._lock = spark, {}, threading.Lock()

    def start(self, action: Callable[[], object]) -> str:
        key = uuid.uuid4().hex
        job = {"state": "running", "result": None, "error": None}

        def run() -> None:
            self.spark.sparkContext.setJobGroup(key, key)
            try:
                job["result"] = action()
                job["state"] = "completed"
            except Exception as error:  # noqa: BLE001 - whatever it is, it is reported
                job["error"], job["state"] = str(error), "failed"

        job["thread"] = threading.Thread(target=run, daemon=True)
        with self._lock:
            self._jobs[key] = job
        job["thread"].start()
        return key

    def status(self, key: str) -> dict:
        """state, error, and tasks done and in all of the stages seen so far; an unknown job is `unknown`."""
        job = self._jobs.get(key)
        if job is None:
            return {"state": "unknown", "done": 0, "tasks": 0, "error": None}
        tracker, done, tasks = self.spark.sparkContext.statusTracker(), 0, 0
        for number in tracker.getJobIdsForGroup(key):
            info = tracker.getJobInfo(number)
            for stage in info.stageIds if info else ():
                if facts := tracker.getStageInfo(stage):
                    done, tasks = done + facts.numCompletedTasks, tasks + facts.numTasks
        return {"state": job["state"], "done": done, "tasks": tasks, "error": job["error"]}

    def result(self, key: str, timeout: float | None = None):
        job = self._jobs[key]
        job["thread"].join(timeout)
        return job["result"]
