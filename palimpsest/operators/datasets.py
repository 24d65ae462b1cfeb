"""Traces of rule-following agents, case plans, containment and provenance of data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.containment import contained
from palimpsest.operators.frames import stored

def canonical_json(*columns: str) -> Column:
    """The columns as one JSON object with sorted keys, no spaces, and ASCII only: all else as lower-case \\u escapes of UTF-16 units."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    low = text
    for digit in "ABCDEF":  # Spark writes control characters with upper-case digits
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    text = F.when(text.rlike(r"\\u00[01][A-F]"), low).otherwise(text)
    units = F.hex(F.encode(text, "UTF-16BE"))
    unit = lambda i: units.substr(4 * i + 1, F.lit(4))
    plain = lambda u: F.decode(F.unhex(u), "UTF-16BE")
    escaped = F.transform(F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1), lambda i: F.when(unit(i).between("0020", "007E"), plain(unit(i))).otherwise(F.concat(F.lit("\\u"), F.lower(unit(i)))))
    return F.when(text.rlike(r"[^ -~]"), F.array_join(escaped, "")).otherwise(text)


def drop_section(text: Column, marker: str, ends: list[str]) -> Column:
    """text without the part from the first match of `marker` up to the nearest match of any of `ends`, or to its end."""
    stop = "|".join(f"(?:{e})" for e in ends)
    cut = F.regexp_replace(text, rf"(?is)\A(.*?)(?:{marker}).*?(?=\z|{stop})(.*)\z", "$1$2")
    return F.when(text.rlike(f"(?i){marker}"), F.regexp_replace(cut, r"\A\s+|\s+\z", "")).otherwise(text)


def byte_bag(text: Column, dim: int = 16, most: int = 256, decay: bool = False) -> Column:
    """Unit vector of byte sums by place modulo dim, over the first `most` bytes (the feature's definition).

    With decay a byte counts by one over its row number, the rows being `dim` bytes long.
    """
    h = F.hex(F.encode(text, "UTF-8"))
    n = F.least(F.lit(most), (F.length(h) / 2).cast("int"))
    weight = lambda i: F.lit(1.0) / (1 + F.floor(i / dim)) if decay else F.lit(1.0)
    byte = lambda i: F.conv(h.substr(2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * weight(i)
    places = lambda s: F.when(s < n, F.sequence(s, n - 1, F.lit(dim))).otherwise(F.array().cast("array<int>"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda s: F.aggregate(places(s), F.lit(0.0), lambda a, i: a + byte(i)))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def agent_trace(cases: DataFrame, cited: Column, act: dict[str, str], careful: Column) -> DataFrame:
    """case_id, n, tool, cited: an agent's plan as rows.

    It retrieves the policy, inspects evidence where `careful`, acts by the expected resolution (`act`; none: no act) and finalizes.
    """
    act_tool = F.coalesce(*[F.when(F.col("expected") == k, v) for k, v in act.items()])
    plan = F.filter(F.array(F.lit("retrieve_policy"), F.when(careful, "inspect_evidence"), act_tool, F.lit("finalize_case")), lambda t: t.isNotNull())
    steps = cases.select("case_id", cited.alias("cited"), F.posexplode(plan).alias("n", "tool"))
    return steps.select("case_id", (F.col("n") + 1).cast("long").alias("n"), "tool", "cited")


def case_plan(templates: DataFrame, versions: DataFrame, seed: int = 42) -> DataFrame:
    """Every template in every version with a time in the version's window, chosen by hash; boundary templates (column `boundary`)
    snap to the version's start, 6 hours before it or 6 or 12 after. An open window is taken as two years.
    """
    number = lambda tag: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{tag}:"), "template", F.lit(":"), "version"), 256), 1, 8), 16, 10).cast("long")
    end = F.coalesce("expires_at", F.expr("effective_at + interval 730 days"))
    days = F.greatest(F.lit(1), F.datediff(end, "effective_at"))
    grid = templates.crossJoin(F.broadcast(versions.select("version", "effective_at", "expires_at").distinct()))  # versions: a literal calendar
    inside = F.col("effective_at") + F.make_dt_interval((number("day") % days).cast("int"), (number("hour") % 24).cast("int"))
    near = F.col("effective_at") + F.make_dt_interval(F.lit(0), F.element_at(F.array(F.lit(-6), F.lit(6), F.lit(12)), (number("snap") % 3 + 1).cast("int")))
    return grid.select("domain", "template", F.col("version").alias("planned"), F.when(F.col("boundary") & (F.col("version") != "1.0"), near).otherwise(inside).alias("occurred_at"))


def stamp(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Per key the number of rows and an order-free checksum of the columns."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 8), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("checksum"))


def stamp_events(rows: DataFrame, stamps: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, event for each data set that may not be trained on: without a stamp, or changed since it was stamped."""
    j = stamp(rows, key, *columns).join(stamps.select(key, F.col("checksum").alias("_old")), key, "left")
    event = F.when(F.col("_old").isNull(), "missing_stamp").when(F.col("_old") != F.col("checksum"), "hash_changed")
    return j.select(key, event.alias("event")).where("event is not null")


# The versions that may be trained on and those that are held out, the marks of a held-out version, the gate's events.
TRAIN_VERSIONS, EVAL_VERSIONS, LEAST_CLAUSE = ["1.0", "1.1"], ["2.0"], 40
MARKS = ["@2.0", 'version": "2.0"', "version': '2.0'"]
EVENTS = [
    "sft_forbidden_version", "dpo_forbidden_version", "eval_version_mismatch", "case_id_overlap", "cross_split_case_ids", "v2_version_marker_in_train", "v2_policy_text_in_train",
    "eval_reference_in_train", "sft_manifest_hash_mismatch", "dpo_manifest_hash_mismatch", "split_manifest_hash_mismatch", "sft_manifest_path_mismatch", "dpo_manifest_path_mismatch",
]


TEXTS = ["prompt", "chosen", "rejected", "text"]


def together(sft: DataFrame, dpo: DataFrame, held: DataFrame) -> DataFrame:
    """The three sets in one stored table: name (sft, dpo, eval), case_id, policy_version, split, TEXTS, expected_resolution; what a set lacks is null."""
    full = None
    for name, rows in (("sft", sft), ("dpo", dpo), ("eval", held)):
        text = [(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in (*TEXTS, "expected_resolution")]
        one = rows.select(F.lit(name).alias("name"), "case_id", "policy_version", "split", *text)
        full = one if full is None else full.unionByName(one)
    return stored(full, "sets")


def leakage_events(sets: DataFrame, clauses: DataFrame, recorded: DataFrame, found: DataFrame) -> DataFrame:
    """event, n: the thirteen leakage events with the number of rows (versions, ids, clauses, data sets) that show each.

    sets as `together` makes them. clauses: version and text of all policy clauses. recorded and found: name, hash and path of
    the data sets as their manifests say and as they are; recorded also split_hash, the hash that the split's manifest gives.

    What a row shows by itself and what a case shows is counted in one aggregation by case. A clause leaks if a text holds it,
    character for character; only clauses of LEAST_CLAUSE characters or more that no other version has are looked for.
    """
    train = F.col("name") != "eval"
    version = lambda of: F.coalesce(F.col("policy_version").isin(of), F.lit(False))
    blob = F.concat_ws("\n", *TEXTS)
    count = lambda c: F.count_if(c)
    split = F.coalesce("split", F.lit("None"))
    of_case = sets.groupBy("case_id").agg(
        count((F.col("name") == "sft") & ~version(TRAIN_VERSIONS)).alias("a"), count((F.col("name") == "dpo") & ~version(TRAIN_VERSIONS)).alias("b"),
        count(~train & ~version(EVAL_VERSIONS)).alias("other"), count(~train & version(EVAL_VERSIONS)).alias("right"),
        count(train).alias("in_train"), count(~train).alias("in_eval"), (F.min(split) != F.max(split)).alias("crossed"),
        count(train & F.greatest(*[F.contains(blob, F.lit(m)) for m in MARKS])).alias("marked"))
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0))
    row = of_case.agg(
        summed("a").alias(EVENTS[0]), summed("b").alias(EVENTS[1]), (summed("other") + F.when(summed("right") == 0, 1).otherwise(0)).alias(EVENTS[2]),
        count((F.col("in_train") > 0) & (F.col("in_eval") > 0)).alias(EVENTS[3]), count("crossed").alias(EVENTS[4]), summed("marked").alias(EVENTS[5]))
    listed = lambda df, names: df.select(F.explode(F.array(*[F.struct(F.lit(e).alias("event"), F.col(e).cast("long").alias("n")) for e in names])).alias("x")).select("x.*")
    old = clauses.where(~F.coalesce(F.col("version").isin(EVAL_VERSIONS), F.lit(False)))
    only = clauses.where(F.col("version").isin(EVAL_VERSIONS)).select(F.trim("text").alias("text")).where(F.length("text") >= LEAST_CLAUSE)
    only = only.join(old.select(F.trim("text").alias("text")), "text", "left_anti").distinct().withColumn("clause", F.xxhash64("text"))
    snippets = contained(only, "clause", sets.where(train).select(blob.alias("text"))).agg(count("contained").alias("n")).select(F.lit(EVENTS[6]).alias("event"), "n")
    # Equal strings meet by digest; both sides are digests only.
    digests = lambda *cols: F.explode(F.array_compact(F.array(*[F.when(F.trim(c) != "", F.sha2(F.trim(c), 256)) for c in cols]))).alias("d")
    refs = sets.where(~train).select(digests("expected_resolution", "prompt")).distinct()
    copied = sets.where(train).select(digests(*TEXTS)).groupBy("d").agg(F.count(F.lit(1)).alias("m")).join(refs, "d", "left_semi")
    copied = copied.agg(summed("m").alias("n")).select(F.lit(EVENTS[7]).alias("event"), "n")
    j = recorded.select("name", F.col("hash").alias("h"), F.col("path").alias("p"), "split_hash").join(found.select("name", "hash", "path"), "name", "full")
    named = lambda n, c: count((F.col("name") == n) & ~c).alias
    same, there = F.col("h").eqNullSafe(F.col("hash")), F.col("p").eqNullSafe(F.col("path"))
    kept = j.agg(
        named("sft", same)(EVENTS[8]), named("dpo", same)(EVENTS[9]), count(~F.col("split_hash").eqNullSafe(F.col("hash"))).alias(EVENTS[10]), named("sft", there)(EVENTS[11]), named("dpo", there)(EVENTS[12]))
    return listed(row, EVENTS[:6]).unionByName(snippets).unionByName(copied).unionByName(listed(kept, EVENTS[8:]))


def assert_clean(events: DataFrame) -> DataFrame:
    """passed (true), or the query fails with the events that were found: the gate before training."""
    found = events.where("n > 0").agg(F.count(F.lit(1)).alias("m"), F.concat_ws(", ", F.array_sort(F.collect_list("event"))).alias("said"))
    return found.select(F.when(F.col("m") == 0, True).otherwise(F.raise_error(F.concat(F.lit("leakage: "), "said")).cast("boolean")).alias("passed"))


def assert_versions(rows: DataFrame, column: str, allowed: list[str], most: int = 20) -> DataFrame:
    """passed (true), or the query fails with the versions found that may not be trained on; a null version may not either."""
    other = rows.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).groupBy(F.coalesce(F.col(column), F.lit("none")).alias("v")).count()
    found = other.orderBy("v").limit(most).agg(F.count(F.lit(1)).alias("m"), F.concat_ws(", ", F.array_sort(F.collect_list("v"))).alias("said"))
    return found.select(F.when(F.col("m") == 0, True).otherwise(F.raise_error(F.concat(F.lit("forbidden versions: "), "said")).cast("boolean")).alias("passed"))


def clean_split(cases: DataFrame, per_domain: int | None = None) -> DataFrame:
    """case_id, side: held-out cases of the held-out versions as eval; as train those of the training versions that share no customer with them.

    A domain with fewer than `per_domain` training cases is topped up from its cases of other splits, in order of id; eval falls
    back to all cases of the held-out versions if none of them is in the test split.
    """
    held = cases.where(F.col("version").isin(EVAL_VERSIONS))
    some = held.agg(F.coalesce(F.bool_or(F.col("split") == "test"), F.lit(False)).alias("some"))
    ev = held.crossJoin(F.broadcast(some)).where((F.col("split") == "test") | ~F.col("some"))
    free = cases.where(F.col("version").isin(TRAIN_VERSIONS)).join(ev.select("customer"), "customer", "left_anti")
    if per_domain is None:
        train = free.select("case_id")
    else:
        # Only the first per_domain of a domain can be wanted beyond the training split's own, so each window keeps few.
        first = free.where("split <> 'train'").withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("case_id"))).where(F.col("k") <= per_domain)
        n = free.where("split = 'train'").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
        more = first.join(n, "domain", "left").where(F.col("k") <= per_domain - F.coalesce("n", F.lit(0)))
        train = free.where("split = 'train'").select("case_id").unionByName(more.select("case_id"))
    return ev.select("case_id", F.lit("eval").alias("side")).unionByName(train.withColumn("side", F.lit("train")))


def first_of_each(rows: DataFrame, group: str, most: int, *order: str) -> DataFrame:
    """The first `most` rows, the first of each group before all others: by order within both."""
    first = rows.groupBy(group).agg(F.min(F.struct(*order)).alias("_o")).select("_o.*", F.lit(0).alias("_k"))
    few = first.orderBy(*order).limit(most)
    rest = rows.select(*order).join(F.broadcast(few.select(*order)), list(order), "left_anti").orderBy(*order).limit(most).withColumn("_k", F.lit(1))  # few: `most` rows
    return few.unionByName(rest).orderBy("_k", *order).limit(most).drop("_k")


def parse_output(text: Column) -> Column:
    """The answer in a model's output: of its JSON object, else of a line that names one, else its last line, else abstain."""
    blob = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    raw = F.regexp_extract(blob, r"(?s)\{.*\}", 0)
    said = lambda k: F.when(F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit("")) != "", F.get_json_object(raw, f"$.{k}"))
    lines = F.filter(F.transform(F.split(blob, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    named = F.get(F.filter(lines, lambda x: F.lower(x).contains("final_resolution") | F.lower(x).contains("decision")), F.lit(0))
    scraped = F.regexp_replace(F.trim(F.regexp_replace(named, r"\A[^:]*:", "")), r'\A[",]+|[",]+\z', "")
    return F.coalesce(said("final_resolution"), said("final_answer"), said("decision"), F.when(scraped != "", scraped), F.substring(F.get(lines, F.size(lines) - 1), 1, 200), F.lit("abstain"))


def finalized_as(raw: Column, allowed: list[str]) -> tuple[Column, Column]:
    """What a finalizing call resolves to, and whether that is allowed: the part behind cite:KEY|, apply_active_policy for a bare citation, else the text."""
    text = F.trim(raw)
    rest = F.trim(F.substring(text, 6, 1 << 30))
    base = F.when(text.startswith("cite:"), F.when(rest.contains("|"), F.trim(F.regexp_replace(rest, r"(?s)\A[^|]*\|", ""))).otherwise("apply_active_policy")).otherwise(text)
    return base, base.isin(allowed)


def turns(sizes: list[int], most: int) -> list[tuple[int, int, int, int, int]]:
    """(group, visits before, visits, first turn, step) of stretches in which the groups, numbered in order, take turns evenly.

    A group's rows get the turns first, first + step, ... A stretch ends when a turn falls on a group that has run out; all groups that
    have run out are then left out, and the place in the list stays the number of turns taken so far.
    """
    names, left, taken, done, out = list(range(len(sizes))), list(sizes), [0] * len(sizes), 0, []
    while done < most and names:
        n = len(names)
        place = {g: (i - done) % n for i, g in enumerate(names)}  # turns until a group's next one
        span = min(min(left[g] * n + place[g] for g in names), most - done)
        for g in names:
            visits = max(0, -(-(span - place[g]) // n))
            if visits:
                out.append((g, taken[g], visits, done + place[g] + 1, n))
                taken[g] += visits
                left[g] -= visits
        done += span
        names = [g for g in names if left[g]]
    return out


def round_robin(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """(key, turn): one row of each group in turn, groups in order, until `most` are taken; a group that runs out is left out while the place in the list of
    groups goes on from where it was, so the order after that is not by (row, group). Only the first `most` rows of a group can be taken.

    The turns follow from the groups' sizes alone (a number a group on the driver; groups are classes); each row's turn is then a product.
    Null groups take no part.
    """
    first = rows.where(F.col(group).isNotNull()).select(group, key).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_k") <= most)
    sizes = first.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(group).collect()
    found = [(sizes[g][0], before, visits, start, step) for g, before, visits, start, step in turns([r.n for r in sizes], most)]
    kind = dict(rows.dtypes)[group]
    plan = rows.sparkSession.createDataFrame(found, f"_g {kind}, _before long, _visits long, _first long, _step long")
    met = first.join(F.broadcast(plan), (F.col(group) == F.col("_g")) & (F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_visits")))  # a few rows a group
    return met.select(key, (F.col("_first") + (F.col("_k") - F.col("_before") - 1) * F.col("_step")).alias("turn"))


# How sections of a prompt begin.
EXAMPLES = r"\n(?:Optional examples|Examples|Few-shot examples)\s*:\s*\n"
HISTORY = r"\n(?:Policy history|Superseded policies|Older policies|Redundant policy history)\s*:\s*\n"
CURRENT = r"(?:Retrieved current policies:|Current policy(?: clause)?:|Active policy:)"
SCHEMA = r"(?:Available tools:|Tool schema:|Tools:\s*\[|tools\s*=\s*\[)"


def truncate_prompt(text: Column, most: int) -> Column:
    """text within `most` estimated tokens (a quarter of its characters): without its examples, then without its policy history, then with
    its tail cut, while the current policy or else the tool schema and what follows them stay. In that order, as far as needed.
    """
    n = lambda x: F.greatest(F.lit(1), F.floor(F.length(x) / 4))
    later = [rf"\n{CURRENT}", rf"\n{SCHEMA}"]
    one = drop_section(text, EXAMPLES, [HISTORY, *later])
    two = drop_section(one, HISTORY, later)
    mark = F.when(two.rlike(f"(?i){CURRENT}"), F.regexp_extract(two, f"(?is){CURRENT}.*", 0)).when(two.rlike(f"(?i){SCHEMA}"), F.regexp_extract(two, f"(?is){SCHEMA}.*", 0)).otherwise("")
    body = two.substr(F.lit(1), F.length(two) - F.length(mark))
    room = F.greatest(F.lit(0), F.lit(4 * most + 3) - F.length(mark) - F.when(mark != "", 1).otherwise(0))
    cut = F.concat_ws("\n", F.array_compact(F.array(F.regexp_replace(body.substr(F.lit(1), room), r"\s+\z", ""), F.when(mark != "", mark))))
    return F.when(n(text) <= most, text).when(n(one) <= most, one).when(n(two) <= most, two).otherwise(cut)


def budget_pair(prompt: Column, chosen: Column, rejected: Column, most: int = 512, completion: int = 128, prompt_most: int = 384) -> dict[str, Column]:
    """A preference pair within a budget of estimated tokens: completions are cut to theirs, the prompt to what is left; and whether anything was cut."""
    cut = lambda x: F.substring(x, 1, 4 * completion)
    p = truncate_prompt(prompt, min(prompt_most, most - completion))
    return {"prompt": p, "chosen": cut(chosen), "rejected": cut(rejected), "cut": (p != prompt) | (F.length(chosen) > 4 * completion) | (F.length(rejected) > 4 * completion)}
