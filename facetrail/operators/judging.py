"""Judging: lexical matches of facts, verdicts from a judge's answer, fidelity of reasoning, validation of new facts, and the
metric suite of a run."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.functions.claims import hedged
from facetrail.functions.text import fold, one_space
from facetrail.operators import evaluation as E
from facetrail.operators.derive import signature

#: Overlap from which a fact is matched, or in part; overlaps of a grounded reasoning.
MATCH, PARTIAL = 0.55, 0.25
#: Scores of verdicts.
VALUE_SCORES = {"match": 1.0, "partial": 0.5, "mismatch": 0.0}
FAITH_SCORES = {"faithful": 1.0, "partial": 0.5, "unfaithful": 0.0}
#: Stages that a grounded reasoning may name instead of a photo.
STAGES = ("AlignmentVerifier", "CandidateProposer", "OwnerFactAuditor", "RelationInferer")


def tokens(c: Column) -> Column:
    """Distinct words of three letters or more that begin with a letter, lower case."""
    words = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9'_-]*"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def best_matches(targets: DataFrame, facts: DataFrame) -> DataFrame:
    """(user_id, target_id, fact_id, overlap, verdict, score): the fact of the same album that shares most of a target's words.

    targets: (user_id, target_id, text), facts: (user_id, fact_id, text). Words meet by an equality join on album and word, so
    only facts that share one are compared; of equal overlaps the smaller fact_id counts; a target without a match has none."""
    t = targets.select("user_id", "target_id", tokens(F.col("text")).alias("w")).distinct()
    f = facts.select("user_id", "fact_id", F.explode(tokens(F.col("text"))).alias("w")).distinct()
    common = t.select("user_id", "target_id", F.size("w").alias("n"), F.explode("w").alias("w")).join(f, ["user_id", "w"]).groupBy("user_id", "target_id", "n", "fact_id").agg(F.count("*").alias("c"))
    best = common.groupBy("user_id", "target_id").agg(F.min(F.struct((-F.col("c") / F.col("n")).alias("o"), "fact_id")).alias("b"))
    overlap = F.round(F.coalesce(-F.col("b.o"), F.lit(0.0)), 9)
    out = t.select("user_id", "target_id").distinct().join(best, ["user_id", "target_id"], "left").select("user_id", "target_id", F.col("b.fact_id").alias("fact_id"), overlap.alias("overlap"))
    verdict = F.when(F.col("overlap") >= MATCH, "match").when(F.col("overlap") >= PARTIAL, "partial").otherwise("mismatch")
    return out.withColumn("verdict", verdict).withColumn("score", F.when(verdict == "match", 1.0).when(verdict == "partial", 0.5).otherwise(0.0))


def fidelity(path: Column, gold_path: Column, prediction: Column, value: Column) -> Column:
    """Score of a reasoning without a judge, 0.66 at most: 0 if it names no photo and no stage, 0.33 if it does, 0.66 if it also
    shares two fifths of the gold reasoning's words and the prediction fits the value."""
    grounded = F.lower(path).rlike("photo[_ -]?[0-9]+") | path.rlike("|".join(STAGES))
    gold = tokens(gold_path)
    overlap = F.coalesce(F.size(F.array_intersect(gold, tokens(path))) / F.nullif(F.size(gold), F.lit(0)), F.lit(0.0))
    said, parts = fold(F.coalesce(prediction, F.lit(""))), F.filter(F.split(one_space(F.coalesce(value, F.lit(""))), " "), lambda w: F.length(w) > 2)
    fits = (F.coalesce(prediction, F.lit("")) != "") & F.exists(parts, lambda w: F.contains(said, fold(w)) | F.contains(fold(w), said))
    return F.when(~F.coalesce(grounded, F.lit(False)), 0.0).when((overlap >= 0.4) & fits, 0.66).otherwise(0.33)


def json_object(c: Column) -> Column:
    """The JSON object of a judge's answer as a map of texts: the answer itself, what a fence holds, or what stands between
    the first and the last brace, with commas before a closing bracket taken out; null if there is none."""
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    parse = lambda x: F.when(x.rlike(r"^\s*\{"), F.from_json(x, "map<string,string>", options))
    fence = F.regexp_extract(c, r"```(?:json)?\s*\n?([\s\S]*?)\n?```", 1)
    braces = F.regexp_extract(c, r"\{[\s\S]*\}", 0)
    return F.coalesce(parse(c), parse(fence), parse(braces), parse(F.regexp_replace(braces, r",\s*([}\]])", "$1")))


def value_verdict(c: Column) -> Column:
    """match, partial or mismatch as said in prose, null if none is."""
    low = F.lower(one_space(c))
    word = lambda w: low.rlike(rf"(^|[^a-z0-9_]){w}($|[^a-z0-9_])")
    return F.when(word("mismatch") | F.contains(low, F.lit("not match")), "mismatch").when(word("partial"), "partial").when(word("match"), "match")


def faith_verdict(c: Column) -> tuple[Column, Column]:
    """(verdict, score) on faithfulness as said in prose: a score that is named counts, else that of the verdict."""
    low = F.lower(one_space(c))
    verdict = F.when(F.contains(low, F.lit("unfaithful")), "unfaithful").when(F.contains(low, F.lit("partial")), "partial").when(F.contains(low, F.lit("faithful")), "faithful")
    named = F.regexp_extract(low, r"(?:^|[^a-z0-9_])score(?:$|[^a-z0-9_])[^0-9]*(1(?:\.0)?|0(?:\.5|\.0)|0?\.[0-9]+)", 1).try_cast("double")
    default = F.create_map(*[F.lit(x) for kv in FAITH_SCORES.items() for x in kv])[verdict]
    return verdict, F.when(verdict.isNotNull(), F.coalesce(named, default))


def matched_index(c: Column) -> Column:
    """The index that a prose answer names, null if none."""
    return F.regexp_extract(F.lower(one_space(c)), r"(?:^|[^a-z0-9])(?:matched_)?index(?:$|[^a-z0-9_])[^0-9-]*(-?[0-9]+)", 1).try_cast("int")


def read_answer(text: str | None) -> dict | None:
    """json_object on the driver's or a worker's side, for answers that come one by one."""
    raw = (text or "").strip()
    fence = re.search(r"```(?:json)?\s*\n?([\s\S]*?)\n?```", raw)
    braces = re.search(r"\{[\s\S]*\}", raw)
    tries = [raw, fence.group(1) if fence else "", braces.group(0) if braces else ""]
    for t in [*tries, re.sub(r",\s*([}\]])", r"\1", tries[2])]:
        try:
            got = json.loads(t)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


def call_json(requests: DataFrame, client: Callable[[str], str], repair: Callable[[str], dict | None] | None = None, retries: int = 2, budget: int | None = None, key: str = "key", prompt: str = "prompt") -> DataFrame:
    """(key, answer, ok, n_calls, repaired, prompt_words, answer_words) of each distinct request.

    An answer without a JSON object is asked for again, ``retries`` times at most, with a reminder; ``repair`` may read one out
    of prose. ``budget`` bounds the calls of one task (a task's requests beyond it are not sent: ok false, no call). Blank
    prompts are not sent. The client is any callable and is called on the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = budget if budget is not None else 1 << 60
        for b in batches:
            rows = []
            for k, p in zip(b[key], b[prompt]):
                found, calls, fixed, asked, said = None, 0, False, 0, 0
                while found is None and isinstance(p, str) and p.strip() and calls <= retries and left > 0:
                    text = p if not calls else f"{p}\n\nReturn only one valid JSON object."
                    try:
                        answer = client(text)
                    except Exception:  # a failed call is a call, the next try may do
                        answer = ""
                    calls, left = calls + 1, left - 1
                    asked, said = asked + len(text.split()), said + len((answer or "").split())
                    found = read_answer(answer)
                    if found is None and repair is not None:
                        found = repair(answer)
                        fixed = found is not None
                rows.append((k, None if found is None else json.dumps(found, sort_keys=True), found is not None, calls, fixed, asked, said))
            yield pd.DataFrame(rows, columns=[key, "answer", "ok", "n_calls", "repaired", "prompt_words", "answer_words"])

    kind = dict(requests.dtypes)[key]
    return requests.select(key, prompt).distinct().mapInPandas(run, f"{key} {kind}, answer string, ok boolean, n_calls int, repaired boolean, prompt_words int, answer_words int")


def checked_facts(facts: DataFrame, known: DataFrame, least_words: int = 4) -> DataFrame:
    """facts (user_id, fact_id, text, photo_ids) with ``reason``: why a proposed fact is not taken: too_short, hedged,
    no_known_photo (none of its photos is one of the album), repeated (its signature came before, by fact_id); else accepted.

    known: (user_id, photo_id)."""
    ids = facts.select("fact_id", "user_id", F.explode("photo_ids").alias("photo_id")).distinct().join(known.select("user_id", "photo_id").distinct(), ["user_id", "photo_id"], "left_semi").select("fact_id").distinct().withColumn("__known", F.lit(True))
    rows = facts.join(ids, "fact_id", "left").withColumn("__sig", signature(F.col("text")))
    words = F.size(F.filter(F.split(one_space(F.coalesce("text", F.lit(""))), " "), lambda w: w != ""))
    early = F.when(words < least_words, "too_short").when(hedged(F.col("text")), "hedged").when(F.col("__known").isNull(), "no_known_photo")
    rows = rows.withColumn("reason", early)
    first = rows.where("reason is null").groupBy("user_id", "__sig").agg(F.min("fact_id").alias("__first"))
    out = rows.join(first, ["user_id", "__sig"], "left")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("fact_id") > F.col("__first"), "repeated").otherwise("accepted"))).drop("__known", "__sig", "__first")


def metric_suite(rows: DataFrame) -> DataFrame:
    """One row per variant and album: identity (idr, ibr, pir, pir_hard, strict, soft, wrong_face, blank_name), relations
    (prr_id, prr_e2e) and categories (pcr, pcr_e2e, pcr_id), evidence (efs_name, efs_relation, efs_category, efs), ece, n_targets.

    rows: one per variant and registered person with discovered, bound, strict, soft, wrong_face, blank_name, difficulty,
    relation_score, category_score, efs_name, efs_relation, efs_category, confidence; a null relation_score or category_score
    is no target of its kind."""
    hard = lambda c: F.when(F.col("difficulty") == "hard", F.col(c))
    bound = F.col("bound") == 1.0
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    a = rows.groupBy("variant", "user_id").agg(
        F.count("*").alias("n_persons"), F.avg("discovered").alias("idr"), ratio(F.sum("bound"), F.sum("discovered")).alias("ibr"), F.count(hard("bound")).alias("n_hard"), F.avg(hard("discovered")).alias("idr_hard"),
        ratio(F.sum(hard("bound")), F.sum(hard("discovered"))).alias("ibr_hard"), F.avg("strict").alias("strict"), F.avg("soft").alias("soft"), F.avg("wrong_face").alias("wrong_face"), F.avg("blank_name").alias("blank_name"),
        F.avg(F.when(bound, F.col("relation_score"))).alias("prr_id"), F.avg(F.when(F.col("relation_score").isNotNull(), F.when(bound, F.col("relation_score")).otherwise(0.0))).alias("prr_e2e"), F.avg("category_score").alias("pcr"),
        F.avg(F.when(F.col("category_score").isNotNull(), F.when(bound, F.col("category_score")).otherwise(0.0))).alias("pcr_e2e"), F.avg(F.when(bound, F.col("category_score"))).alias("pcr_id"),
        F.avg("efs_name").alias("efs_name"), F.avg("efs_relation").alias("efs_relation"), F.avg("efs_category").alias("efs_category"),
        (F.sum(F.coalesce("efs_name", F.lit(0.0)) + F.coalesce("efs_relation", F.lit(0.0)) + F.coalesce("efs_category", F.lit(0.0))) / F.nullif(F.count("efs_name") + F.count("efs_relation") + F.count("efs_category"), F.lit(0))).alias("efs"),
        (F.count("*") + F.count("relation_score") + F.count("category_score")).alias("n_targets"),
    )
    pir = lambda x, y: F.coalesce(2 * F.col(x) * F.col(y) / F.nullif(F.col(x) + F.col(y), F.lit(0.0)), F.lit(0.0))
    scored = a.withColumn("pir", pir("idr", "ibr")).withColumn("pir_hard", F.when(F.col("n_hard") > 0, pir("idr_hard", "ibr_hard"))).drop("n_hard", "idr_hard", "ibr_hard")
    held = F.array(
        F.struct(F.col("bound").alias("y")), F.struct(F.when(F.col("relation_score").isNotNull(), F.when(bound, F.col("relation_score")).otherwise(0.0)).alias("y")), F.struct(F.when(F.col("category_score").isNotNull(), F.when(bound, F.col("category_score")).otherwise(0.0)).alias("y"))
    )
    calibration = rows.select("variant", "user_id", F.coalesce("confidence", F.lit(0.0)).alias("c"), F.explode(held).alias("h")).where("h.y is not null").select("variant", "user_id", "c", F.col("h.y").alias("y"))
    return scored.join(E.calibration_error(calibration, ["variant", "user_id"], "c", "y").drop("n"), ["variant", "user_id"], "left")


def macro_by(rows: DataFrame, groups: list[str], user: str, value: str) -> DataFrame:
    """Mean over users of the users' means of a value, by group: every user counts alike."""
    return rows.where(F.col(value).isNotNull()).groupBy(*groups, user).agg(F.avg(value).alias("m")).groupBy(*groups).agg(F.count("*").alias("n_users"), F.avg("m").alias(value))


def last_first(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by order."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where("__k = 1").drop("__k")
