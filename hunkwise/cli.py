"""The command line: one diff in, its hunks in reading order out.

Exit codes: 0 when all is well, 1 when a hunk reaches ``--fail-over``, 2 when what was asked for cannot
be had. Many diffs at once are read by ``--diffs FOLDER``, one document each.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise import __version__
from hunkwise.operators import budgets, enrich, render, score
from hunkwise.operators.context_rules import file_stats, parse_codeowners
from hunkwise.operators.profiles import ProfileError, composed
from hunkwise.plans.config import FILE_NAME, Config, ConfigError, load_config
from hunkwise.plans.config import spark as session
from hunkwise.plans.review import Options, review
from hunkwise.sources import connectors

PROGRAM = "hunkwise"
OK, TRIPPED, UNUSABLE = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=PROGRAM, description="Ranks the hunks of a unified diff by risk, and says what to read first.")
    add = p.add_argument
    add("--version", action="version", version=f"{PROGRAM} {__version__}")
    source = p.add_mutually_exclusive_group()
    source.add_argument("--staged", action="store_true", help="read the diff of git's index instead of standard input")
    source.add_argument("--range", dest="range_spec", metavar="A..B", help="read the diff of a git range")
    source.add_argument("--diffs", metavar="FOLDER", help="read every diff file below a folder, one document each")
    output = p.add_mutually_exclusive_group()
    output.add_argument("--json", action="store_true", help="write the hunks as a JSON array")
    output.add_argument("--markdown", action="store_true", help="write a Markdown reading list for a pull request")
    output.add_argument("--sarif", action="store_true", help="write a SARIF log")
    output.add_argument("--context-budget", metavar="SPEC", help="write a bundle for a model: '6000tok' or '8hunks'")
    add("--title", metavar="TEXT", help="heading of the Markdown list, title of the SARIF log, stated intent of the bundle")
    add("--no-color", action="store_true", help="plain text on a terminal, too")
    add("--budget", metavar="SPEC", help="draw a line in the menu: '5m', '90s', '1m30s' or '10hunks'")
    add("--fail-over", metavar="SCORE", type=int, help="exit with 1 if a hunk scores as much")
    add("--blast-radius", action="store_true", help="count uses of changed names in the repository")
    add("--hotspots", action="store_true", help="look for often changed and often fixed files in the history")
    add("--owners", action="store_true", help="look for files that CODEOWNERS gives to others than --author")
    add("--no-tests", action="store_true", help="look for risky changes without changed tests")
    add("--author", metavar="LOGIN", help="the author's handle, for --owners")
    add("--intent", metavar="TEXT", help="what the change is about; hunks without a shared word stand out")
    add("--intent-from-pr", metavar="NUMBER", help="take the intent from a pull request, by gh; --intent goes before")
    add("--repo-slug", metavar="OWNER/REPO", help="the pull request's repository")
    add("--explain-llm", action="store_true", help=f"add notes on the top hunks by the backend that {enrich.VARIABLE} names")
    add("--explain-llm-top", metavar="N", type=int, default=enrich.TOP, help="on how many hunks (default %(default)s)")
    config = p.add_mutually_exclusive_group()
    config.add_argument("--config", metavar="PATH", help=f"settings file, instead of the nearest {FILE_NAME}")
    config.add_argument("--no-config", action="store_true", help="no settings file")
    add("--as", dest="profiles", metavar="PROFILE", action="append", default=[], help="weigh as a reviewer would: backend, frontend, security, or of the settings; may be repeated")
    return p


def options(args: argparse.Namespace, config: Config, spark: SparkSession, repo: str) -> Options:
    """The review that the flags ask for; a rule whose source is missing is left out."""
    tree = connectors.repo_tree(spark, repo) if args.blast_radius else None
    history = connectors.repo_history(spark, repo) if args.hotspots else None
    codeowners = (connectors.find_codeowners(repo) or "") if args.owners else ""
    intent = args.intent
    if intent is None and args.intent_from_pr is not None:
        intent = connectors.intent_from_pr(args.intent_from_pr, args.repo_slug)
    return Options(
        weights=config.weights, extra_surface=config.extra_surface, custom_profiles=config.profiles,
        tree=tree, file_stats=file_stats(history) if history is not None else None,
        codeowners=parse_codeowners(codeowners), author=(args.author or "").strip(), intent=F.lit(intent) if intent and intent.strip() else None,
        no_tests=args.no_tests, profiles=[n.strip() for chunk in args.profiles for n in chunk.split(",") if n.strip()],
    )


def documents(args: argparse.Namespace, hunks: DataFrame, diffs: DataFrame, color: bool) -> DataFrame:
    """diff_id, document in the form that is asked for."""
    if args.json:
        return render.json_documents(hunks, diffs)
    if args.markdown:
        return render.markdown(hunks, args.title, args.fail_over, diffs)
    if args.sarif:
        return render.sarif(hunks, args.title, args.fail_over, diffs, version=__version__)
    if args.context_budget is not None:
        blocks = render.bundle_blocks(hunks)
        return render.bundle(budgets.within(blocks, budgets.parse_context_budget(args.context_budget), render.block_cost()), args.title, diffs)
    if args.budget is not None:
        budget = budgets.parse_budget(args.budget)
        return render.menu(budgets.within(hunks, budget), budget, color=color, diffs=diffs)
    return render.menu(hunks, color=color, diffs=diffs)


def main(argv: Sequence[str] | None = None, stdin: TextIO | None = None, spark: SparkSession | None = None, repo: str = ".") -> int:
    args, stdin = parser().parse_args(argv), stdin or sys.stdin
    piped = not (args.staged or args.range_spec is not None or args.diffs)

    def complain(words: object) -> None:
        print(f"{PROGRAM}: {words}", file=sys.stderr)

    if piped and stdin.isatty():
        parser().print_usage()
        complain(f"there is no diff on standard input; pipe one (git diff | {PROGRAM}), or use --staged or --range A..B")
        return OK
    try:
        config = load_config(Path(args.config) if args.config else None, Path(repo), not args.no_config)
        composed([n for chunk in args.profiles for n in chunk.split(",")], config.profiles)
        for spec, read in ((args.budget, budgets.parse_budget), (args.context_budget, budgets.parse_context_budget)):
            if spec is not None and not (spec is args.budget and (args.json or args.markdown or args.sarif or args.context_budget is not None)):
                read(spec)
        text = None if args.diffs else stdin.read() if piped else connectors.git_diff(repo, args.staged, args.range_spec)
        backend = enrich.resolve_backend() if args.explain_llm and args.explain_llm_top > 0 and (args.diffs or "@@ -" in (text or "")) else None
        spark = spark or session()
        diffs = connectors.read_diffs(spark, args.diffs) if args.diffs else connectors.diffs_of(spark, [("stdin", text or "")])
        hunks = review(diffs, options(args, config, spark, repo))
        if backend is not None:
            hunks = enrich.enrich(hunks, backend, args.explain_llm_top)
        color = not args.no_color and sys.stdout.isatty()
        for row in documents(args, hunks, diffs, color).orderBy("diff_id").toLocalIterator():
            print(json.dumps(json.loads(row.document), indent=2) if args.json or args.sarif else row.document)
        if args.fail_over is not None:
            worst = score.gate(hunks, args.fail_over).where("tripped").agg(F.max("worst")).first()[0]
            if worst is not None:
                complain(f"a hunk scored {worst}, which reaches {args.fail_over}")
                return TRIPPED
    except (ConfigError, ProfileError, budgets.BudgetError, connectors.SourceError, enrich.EnrichmentError) as e:
        complain(e)
        return UNUSABLE
    except BrokenPipeError:
        return OK  # who reads has read enough
    except Exception as e:  # noqa: BLE001 - exit code 1 is the gate's alone
        words = (str(e).strip() or type(e).__name__).splitlines()
        if "EnrichmentError" in str(e):  # raised on an executor
            complain("the backend failed: " + str(e).split("EnrichmentError:")[-1].strip().splitlines()[0])
        else:
            complain(f"failed: {words[0]}")
        return UNUSABLE
    return OK
