"""What changed between two snapshots: full outer joins by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.canonical import canonical
from assaykit.functions.scalars import has_text, rounded

#: Lifecycle states that end a candidate (fixed values).
TERMINAL = ("completed", "rejected", "deferred", "superseded", "out-of-scope")


def _both(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either snapshot as structs p and c, one row a key; of repeated keys the greatest row counts."""
    one = lambda df, name: df.groupBy(*keys).agg(F.max(F.struct(*[c for c in df.columns if c not in keys])).alias(name))
    return one(previous, "p").join(one(current, "c"), list(keys), "full_outer")


def transitions(previous: DataFrame, current: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, transition (new, changed, dropped), previous and current value; unchanged rows are silent."""
    x = _both(previous.select(*keys, value), current.select(*keys, value), keys)
    was, now = F.col(f"p.{value}"), F.col(f"c.{value}")
    how = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "dropped").when(~was.eqNullSafe(now), "changed")
    return x.select(*keys, how.alias("transition"), was.alias("previous"), now.alias("current")).where("transition IS NOT NULL")


def number_changes(previous: DataFrame, current: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, previous, current, change to two decimals, for keys of both snapshots with a previous value."""
    x = previous.select(*keys, F.col(value).alias("previous")).join(current.select(*keys, F.col(value).alias("current")), list(keys))
    return x.where("previous IS NOT NULL").withColumn("change", rounded(F.col("current") - F.col("previous"), 2))


def report_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, kind (new, carried or resolved), previous, current, change to two decimals (null unless both have a value)."""
    x = _both(previous.select(*keys, value), current.select(*keys, value), keys)
    was, now = F.col(f"p.{value}"), F.col(f"c.{value}")
    kind = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "resolved").otherwise("carried")
    return x.select(*keys, kind.alias("kind"), was.alias("previous"), now.alias("current"), rounded(now - was, 2).alias("change"))


def state_changes(previous: DataFrame, current: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, previous, current where both snapshots have the key and the value differs."""
    return transitions(previous, current, keys, value).where("transition = 'changed'").drop("transition")


def candidate_transitions(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, transition, problem. previous: status, lifecycle_status, reason, completed_at, n_refs, superseded_by.

    new, carried or reopened where the candidate is still there. Absence is no completion: a missing one needs a
    terminal state and what that state asks for, and is a problem otherwise.
    """
    x = _both(previous, current.select(*keys, F.lit(True).alias("there")), keys)
    state = F.coalesce("p.lifecycle_status", F.lit(""))
    told = (
        F.when(state == "completed", has_text(F.col("p.completed_at")) & (F.coalesce("p.n_refs", F.lit(0)) > 0))
        .when(state == "superseded", has_text(F.col("p.superseded_by")))
        .otherwise(has_text(F.col("p.reason")))
    )
    gone, terminal = F.col("c").isNull(), state.isin(*TERMINAL)
    how = (
        F.when(F.col("p").isNull(), "new")
        .when(~gone & F.col("p.status").eqNullSafe("completed"), "reopened")
        .when(~gone, "carried")
        .when(terminal & told, state)
        .otherwise("missing-from-current-run")
    )
    problem = F.when(gone & terminal & ~told, "candidate-resolution-missing").when(gone & ~terminal, "candidate-continuity")
    return x.select(*keys, how.alias("transition"), problem.alias("problem"))


def stored_mismatches(rows: DataFrame, subject: Sequence[str], pairs: dict[str, str], digits: int = 2) -> DataFrame:
    """subject, field, stored, computed where a stored number isn't the computed one after rounding; null isn't stored."""
    each = F.array(*[F.struct(F.lit(s).alias("field"), F.col(s).cast("double").alias("stored"), rounded(F.col(c).cast("double"), digits).alias("computed")) for s, c in pairs.items()])
    x = rows.select(*subject, F.inline(each))
    return x.where(F.col("stored").isNotNull() & (rounded(F.col("stored"), digits) != F.col("computed")))


def stored_states(rows: DataFrame, subject: Sequence[str], pairs: dict[str, str]) -> DataFrame:
    """subject, field, stored, computed where a stored word (a grade, a band) isn't the computed one; null isn't stored."""
    each = F.array(*[F.struct(F.lit(s).alias("field"), F.col(s).cast("string").alias("stored"), F.col(c).cast("string").alias("computed")) for s, c in pairs.items()])
    x = rows.select(*subject, F.inline(each))
    return x.where(F.col("stored").isNotNull() & ~F.col("stored").eqNullSafe(F.col("computed")))


def reuse_class(entries: DataFrame, wanted: DataFrame, key: str, exact: Sequence[str], content: Sequence[str], warm: Sequence[str]) -> DataFrame:
    """key, reuse: exact, content-stable, warm-only or miss, by which fingerprints of a cached entry still agree."""
    cols = list(dict.fromkeys([*exact, *content, *warm]))
    x = wanted.select(key, *[F.col(c).alias(f"_w_{c}") for c in cols]).join(entries.select(key, *cols, F.lit(True).alias("_there")), key, "left")
    same = lambda cs: F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in cs]), lambda b: b)
    how = F.when(F.col("_there").isNull(), "miss").when(same(exact), "exact").when(same(content), "content-stable").when(same(warm), "warm-only").otherwise("miss")
    return x.select(key, how.alias("reuse"))


def reuse_counts(reuse: DataFrame, *keys: str) -> DataFrame:
    """keys, reuse, n, share: how often each class of reuse came, and its share of all to 3 decimals. reuse: of reuse_class()."""
    n = reuse.groupBy(*keys, "reuse").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 3))


def cache_key(*fields: str):
    """SHA-256 of a descriptor's fields as a JSON object with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


#: Fields of a cached result's descriptor (fixed values).
DESCRIPTOR = ("schema_version", "namespace", "repository_key", "lane_id", "contract_version", "input_fingerprint", "dependency_fingerprint", "environment_fingerprint", "scope")


def descriptor_key(descriptors: DataFrame) -> DataFrame:
    """descriptors with key: the SHA-256 of all nine fields, a missing scope as null."""
    return descriptors.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(DESCRIPTOR)), {"ignoreNullFields": "false"}), 256))


def value_key(rows: DataFrame, value: str, key: str = "key") -> DataFrame:
    """rows with the SHA-256 of the canonical JSON of a VARIANT of any depth: equal values have equal keys, whatever the order of
    their fields."""
    told = canonical(rows, value, "_text")
    return told.withColumn(key, F.sha2(F.col("_text").cast("binary"), 256)).drop("_text")


def lane_descriptors(lanes: DataFrame, files: DataFrame) -> DataFrame:
    """lanes (lane_id and further fields) with the fingerprints of their input and dependency files.

    files: lane_id, role (input or dependency), path, sha256. A fingerprint is the SHA-256 of the sorted paths and hashes.
    """
    told = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), "\n")
    by_role = files.groupBy("lane_id").pivot("role", ["input", "dependency"]).agg(F.sha2(told, 256))
    x = lanes.join(by_role, "lane_id", "left")
    nothing = F.sha2(F.lit(""), 256)
    return x.select(*lanes.columns, F.coalesce("input", nothing).alias("input_fingerprint"), F.coalesce("dependency", nothing).alias("dependency_fingerprint"))


def environment_fingerprint(values: Column) -> Column:
    """The SHA-256 of a map of environment values as JSON, whatever their order; null counts as an empty map."""
    entries = F.array_sort(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>"))))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def full_descriptors(lanes: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """lane_descriptors() with what a cached result also depends on: the lane's environment, and the revision and working tree
    of its repository, and a key of it all.

    lanes: lane_id, repository_key, environment (map), further fields; repositories: repository_key, source_revision,
    working_tree_fingerprint. A lane of an unknown repository has neither.
    """
    x = lane_descriptors(lanes, files).withColumn("environment_fingerprint", environment_fingerprint(F.col("environment"))).drop("environment")
    x = x.join(repositories.select("repository_key", "source_revision", "working_tree_fingerprint"), "repository_key", "left")
    return x.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(x.columns)), {"ignoreNullFields": "false"}), 256))
