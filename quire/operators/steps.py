"""Chains of named steps on pages (doc_id, page_no, text): checked as a whole, planned as one query, run with progress and a way out.

compiled() looks at every step's name and arguments before anything runs and gives one function of a table to a table,
which plans nothing but a DataFrame. run() writes its result under a job group: a status tracker tells how many tasks are
done, and when the caller says stop the group's jobs are cancelled. The result is written beside its place and moved
there at the end, so a run that failed or was cancelled leaves nothing.
"""

from __future__ import annotations

import inspect
import typing
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import repair_text
from quire.operators import pages, search


class BadStep(ValueError):
    """A step that can't be run, by its number."""


class Cancelled(RuntimeError):
    """The caller's progress function said stop."""


def repair(df: DataFrame) -> DataFrame:
    """Texts as they were meant."""
    return df.withColumn("text", repair_text("text"))


def replace(df: DataFrame, term: str, by: str, match_case: bool = True) -> DataFrame:
    return search.replace_text(df, term, by, match_case).select(df.columns)


def redact(df: DataFrame, term: str, match_case: bool = True) -> DataFrame:
    return search.redact_term(df, term, match_case).select(df.columns)


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "repair": repair, "replace": replace, "redact": redact, "extract": pages.extract_pages, "choose": pages.choose_pages, "duplicate": pages.duplicate_page, "delete": pages.delete_page, "insert": pages.insert_blank, "reorder": pages.reorder_page, "move": pages.move_page, "find": search.find, "count": search.count_matches,
}


def _fits(value: object, kind: object) -> bool:
    if typing.get_origin(kind) is list:
        return isinstance(value, list) and all(_fits(v, typing.get_args(kind)[0]) for v in value)
    return isinstance(value, kind) and (kind is bool or not isinstance(value, bool)) if isinstance(kind, type) else True


def compiled(steps: Sequence[tuple[str, Mapping[str, object]]], tools: Mapping[str, Callable[..., DataFrame]] = TOOLS) -> Callable[[DataFrame], DataFrame]:
    """The steps (name, arguments) as one function; BadStep names the first that has no such tool, or the wrong arguments."""
    if not steps:
        raise BadStep("no steps")
    bound = []
    for n, (name, args) in enumerate(steps, 1):
        if name not in tools:
            raise BadStep(f"step {n}: no tool is called {name!r}")
        signature, kinds = inspect.signature(tools[name]), typing.get_type_hints(tools[name])
        try:
            call = signature.bind(None, **args)
        except TypeError as error:
            raise BadStep(f"step {n} ({name}): {error}") from None
        for key, value in list(call.arguments.items())[1:]:
            if not _fits(value, kinds.get(key)):
                raise BadStep(f"step {n} ({name}): {key} can't be {value!r}")
        bound.append((n, name, tools[name], dict(args)))

    def chain(df: DataFrame) -> DataFrame:
        for n, name, tool, args in bound:
            try:
                df = tool(df, **args)
            except Exception as error:  # the columns that a tool needs are only known now; still before any job
                raise BadStep(f"step {n} ({name}): {error}") from error
        return df

    return chain


def _tasks(spark: SparkSession, group: str) -> tuple[int, int]:
    """How many tasks of a group's jobs are done, and how many there are so far."""
    tracker, done, known = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if s := tracker.getStageInfo(stage):
                # a job that is over has skipped the stages that it didn't need
                done, known = done + s.numCompletedTasks, known + (s.numTasks if info.status == "RUNNING" else s.numCompletedTasks)
    return done, known


def run(df: DataFrame, chain: Callable[[DataFrame], DataFrame], path: str, progress: Callable[[int, int], object] | None = None, every: float = 0.2) -> DataFrame:
    """Writes chain(df) to path as Parquet and reads it again.

    progress(done, known) is asked again and again while jobs run; if it returns False they are cancelled and Cancelled is
    raised. Nothing may lie at path.
    """
    spark, group = df.sparkSession, f"steps-{uuid.uuid4().hex}"
    context, result, beside = spark.sparkContext, chain(df), f"{path.rstrip('/')}.{group}"
    place, temporary = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
    store = place.getFileSystem(context._jsc.hadoopConfiguration())
    if store.exists(place):
        raise FileExistsError(path)
    failed: list[BaseException] = []

    def write() -> None:
        context.setJobGroup(group, "steps", interruptOnCancel=False)
        try:
            result.write.parquet(beside)
        except BaseException as error:  # noqa: BLE001  it is raised again below
            failed.append(error)

    stop = False
    worker = InheritableThread(target=write)
    try:
        worker.start()
        while worker.is_alive():
            if progress and not stop and progress(*_tasks(spark, group)) is False:
                stop = True
            if stop:
                context.cancelJobGroup(group)  # again, for jobs that begin meanwhile
            worker.join(every)
        if progress and not stop and not failed:
            stop = progress(*_tasks(spark, group)) is False
        if stop:
            raise Cancelled(path)
        if failed:
            raise failed[0]
        if not store.rename(temporary, place):
            raise OSError(f"{beside} can't be moved to {path}")
    finally:
        worker.join()
        store.delete(temporary, True)
    return spark.read.schema(result.schema).parquet(path)
