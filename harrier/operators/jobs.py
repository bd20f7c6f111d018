"""Jobs: identities of work, leases, retries and recovery, as expressions over a table of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as X


def cache_key(query: Column, generation: Column, *scope: Column) -> Column:
    """The hash of a question's hash, the generation of the index, and whatever limits what may be seen."""
    return F.sha2(F.concat_ws("|", F.sha2(query, 256), generation, *scope), 256)


def provenance(*parts: Column) -> Column:
    """The hash by which saved answers are the same."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def question_identity(ordinal: Column, question: Column) -> Column:
    """ordinal:sha256 of the question without case and needless white space."""
    return F.concat_ws(":", ordinal.cast("string"), F.sha2(F.lower(X.clean(question)), 256))


def lease_until(now: Column, seconds: int) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def age_seconds(since: Column, now: Column) -> Column:
    """Whole seconds, never below 0; null if since is."""
    return F.when(since.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(since)))


def after_failure(jobs: DataFrame, now: Column, attempts: str = "attempts", cap: int = 5, base: float = 30.0) -> DataFrame:
    """jobs with next_state (retry_wait, or failed once the cap is reached) and available_at, null if it won't run again."""
    again = F.col(attempts) < cap
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), X.backoff(F.col(attempts), base).cast("decimal(18,6)"))
    return jobs.withColumn("next_state", F.when(again, "retry_wait").otherwise("failed")).withColumn("available_at", F.when(again, now + wait))


def recovered(jobs: DataFrame, now: Column, state: str = "state", lease: str = "lease_expires", attempts: str = "attempts", cap: int = 5, base: float = 30.0) -> DataFrame:
    """The running jobs whose lease is over, as they go on: see ``after_failure``."""
    return after_failure(jobs.filter((F.col(state) == "running") & (F.col(lease) <= now)), now, attempts, cap, base)


def current_revision(jobs: DataFrame, notes: DataFrame, key: str, revision: str) -> DataFrame:
    """Jobs of a note's current revision; those of older ones are superseded."""
    now = notes.select(F.col(key).alias("__key"), F.col(revision).alias("__rev"))
    return jobs.join(now, (F.col(key) == F.col("__key")) & (F.col(revision) == F.col("__rev")), "left_semi")
