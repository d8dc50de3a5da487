"""The operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.functions.signals import none
from hunkwise.operators import budgets, context_rules, enrich, parse, render, rules, score
from hunkwise.plans.review import Options, review
from hunkwise.sources import corpus
from hunkwise.sources.worktables import WorkTables

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["diff_id", "file_seq", "hunk_seq"]
HUNKS, SECONDS, TOKENS, GATE = 3, 180, 1200, 80
PROFILE_SETS = (["backend"], ["frontend"], ["security"], ["backend", "security"])


def _hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_hunks(corpus.diffs(spark, sf_dir))


def _long(hunks: DataFrame) -> DataFrame:
    out = hunks.select(*KEY, F.posexplode("signals").alias("ord", "s"))
    return out.select(*KEY, (F.col("ord") + 1).alias("ord"), "s.rule", "s.points", "s.reason")


def _rule(signals: Callable[[], Column]) -> Query:
    return lambda spark, d: _long(rules.with_text(_hunks(spark, d)).withColumn("signals", signals()))


def _added_to_nothing(add: Callable[[SparkSession, str, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: _long(add(spark, d, _hunks(spark, d).withColumn("signals", none())))


def _reviewed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return review(corpus.diffs(spark, sf_dir), Options(**options))


def _ranked(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _reviewed(spark, sf_dir, **options).select(*KEY, "id", "file_path", "raw", "score", "tier", "rank", score.why().alias("why"))

    return run


def parse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_files(corpus.diffs(spark, sf_dir))


def parse_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hunks(spark, sf_dir).withColumn("body_md5", F.md5(F.col("body").cast("binary"))).drop("body", "id")


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.diff_counts(_hunks(spark, sf_dir), parse_files(spark, sf_dir))


def budget_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets.within(_reviewed(spark, sf_dir), budgets.Budget(seconds=SECONDS)).select(*KEY, "rank", "cost", "spent", "reviewed")


def budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = budgets.budget_summary(budgets.within(_reviewed(spark, sf_dir), budgets.parse_budget("3m")))
    return out.withColumn("total_text", budgets.duration(F.col("total_seconds")))


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets.within(render.bundle_blocks(_reviewed(spark, sf_dir)), budgets.parse_context_budget(f"{TOKENS}tok"), render.block_cost())


def menu_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide enough that no row wraps."""
    budget = budgets.Budget(seconds=SECONDS)
    return render.menu(budgets.within(_reviewed(spark, sf_dir), budget), budget, width=5000)


def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("hunks"), F.countDistinct("diff_id").alias("diffs"))


def echo_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks = _reviewed(spark, sf_dir)
    return enrich.with_notes(hunks, enrich.echo_notes(enrich.requests(hunks))).select(*KEY, score.why().alias("why"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON objects, read again."""
    schema = "id string, file string, old_start int, new_start int, added int, removed int, score int, raw int, signals array<struct<rule:string,points:int,reason:string>>"
    rows = render.json_rows(_reviewed(spark, sf_dir)).withColumn("j", F.from_json("json", schema))
    return rows.select("diff_id", "rank", "j.*").withColumn("n_signals", F.size("signals")).drop("signals")


def no_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_reviewed(spark, sf_dir, no_tests=True)).where("rule = 'no-tests'").drop("ord")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hunks(spark, sf_dir).select(*KEY, F.explode(context_rules.symbols()).alias("symbol"))


def _own_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WorkTables(spark).put(context_rules.hunk_symbols(_hunks(spark, sf_dir)))


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = WorkTables(spark)
    hunks = tables.put(_hunks(spark, sf_dir).select(*KEY, "file_path", context_rules.symbols().alias("symbols"), none().alias("signals")))
    own = context_rules.hunk_symbols(hunks, F.col("symbols"))
    return _long(context_rules.with_blast_radius(hunks, own, corpus.tree(spark, sf_dir), tables))


def owners_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by thousands of entries."""
    return _long(context_rules.with_owners(_hunks(spark, sf_dir).withColumn("signals", none()), corpus.many_codeowners(), corpus.AUTHOR))


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules and a profile in one review."""
    return _ranked(
        pack="library", tree=corpus.tree(spark, sf_dir), bodies=False, file_stats=context_rules.file_stats(corpus.commits(spark, sf_dir)), codeowners=context_rules.parse_codeowners(corpus.CODEOWNERS), author=corpus.AUTHOR,
        intent=F.lit(corpus.INTENT), no_tests=True, profiles=["security"],
    )(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "rank_hunks": _ranked(),
    "rank_hunks_library": _ranked(pack="library"),
    "review_everything": everything,
    "parse_files": parse_files,
    "parse_hunks": parse_hunks,
    "hunk_ids": lambda s, d: _hunks(s, d).select(*KEY, "id"),
    "diff_counts": diff_counts,
    "file_rollup": lambda s, d: parse.file_rollup(_hunks(s, d)),
    "rule_size": _rule(rules.size),
    "rule_surface": _rule(rules.surface),
    "rule_surface_extra": _rule(lambda: rules.surface(corpus.EXTRA_SURFACE)),
    "rule_danger": _rule(rules.danger),
    "rule_control": _rule(rules.control),
    "weighted_scores": _ranked(weights=corpus.WEIGHTS),
    **{f"profile_{'_'.join(names)}": _ranked(profiles=names) for names in PROFILE_SETS},
    "budget_count": lambda s, d: budgets.within(_reviewed(s, d), budgets.Budget(hunks=HUNKS)).select(*KEY, "rank", "reviewed"),
    "budget_time": budget_time,
    "budget_summary": budget_summary,
    "context_tokens": lambda s, d: _taken(s, d).select(*KEY, "rank", "tokens", "spent", "reviewed"),
    "fail_over": lambda s, d: score.gate(_reviewed(s, d), GATE),
    "tier_histogram": tier_histogram,
    "menu_summary": lambda s, d: score.summary(_reviewed(s, d)),
    "top_n_requests": lambda s, d: enrich.requests(_reviewed(s, d)),
    "echo_notes": echo_notes,
    "json_rows": json_rows,
    "text_rows": lambda s, d: render.text_rows(_reviewed(s, d)),
    "menu_documents": menu_documents,
    "json_documents": lambda s, d: render.json_documents(_reviewed(s, d)),
    "markdown_rows": lambda s, d: render.markdown_rows(_reviewed(s, d)),
    "markdown_documents": lambda s, d: render.markdown(_reviewed(s, d), fail_over=GATE),
    "sarif_results": lambda s, d: render.sarif_results(_reviewed(s, d)),
    "sarif_documents": lambda s, d: render.sarif(_reviewed(s, d), fail_over=GATE),
    "bundle_documents": lambda s, d: render.bundle(_taken(s, d), corpus.INTENT),
    "bundle_blocks": lambda s, d: render.bundle_blocks(_reviewed(s, d)).select(*KEY, "rank", F.md5(F.col("block").cast("binary")).alias("block_md5"), "tokens"),
    "file_churn": lambda s, d: context_rules.file_stats(corpus.commits(s, d)),
    "hotspots": _added_to_nothing(lambda s, d, h: context_rules.with_hotspots(h, context_rules.file_stats(corpus.commits(s, d)))),
    "owners": _added_to_nothing(lambda s, d, h: context_rules.with_owners(h, context_rules.parse_codeowners(corpus.CODEOWNERS), corpus.AUTHOR)),
    "intent": _added_to_nothing(lambda s, d, h: context_rules.with_intent(h, F.lit(corpus.INTENT))),
    "no_tests": no_tests,
    "symbols": symbols,
    "symbol_uses": lambda s, d: context_rules.symbol_uses(_own_symbols(s, d), corpus.tree(s, d)),
    "blast_radius": blast_radius,
    "owners_index": owners_index,
}
