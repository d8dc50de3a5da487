"""Rows and documents for people and tools, from ranked hunks. Documents are per diff, as long as its own text.

A diff without hunks has no rows. Where ``diffs`` (diff_id) are given, documents say so for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.operators.budgets import Budget, TimeModel, duration, tokens
from hunkwise.operators.parse import header
from hunkwise.operators.score import TIERS, why

#: The name that documents bear.
NAME = "hunkwise"
# Fixed values of the presentations: marks of the tiers, words, widths and table heads.
LABEL = {"gulp": "GULP", "sip": "SIP ", "savor": "SAVR"}
EMOJI = {"gulp": "🔴", "sip": "🟡", "savor": "🟢"}
LEVEL = {"gulp": "error", "sip": "warning", "savor": "note"}
QUIET = "no notable signals — skim-safe"
SAFE_RULE, SAFE_MESSAGE = "skim-safe", "No notable risk signals — skim-safe."
BAR_CELLS, WIDTH, LEAST_WIDTH, LEAST_WHY, MOST_RULE = 20, 100, 40, 24, 120
TABLE_HEAD = "| | # | Tier | Score | Location | Why |\n|---|---:|---|---:|---|---|"
RULE_TEXTS = {
    "size": "The hunk changes a large number of lines.",
    "surface": "The hunk touches a sensitive surface (auth, CI, config, infra, ...).",
    "danger": "The hunk contains a risky construct (eval/exec, secrets, a large deletion, ...).",
    "blast-radius": "The hunk changes a symbol used widely elsewhere in the repo.",
    "hotspots": "The hunk lands in a historically bug-prone file (high churn / fix frequency).",
    "skim-safe": "No notable risk signals fired — this hunk is skim-safe.",
}
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
PREAMBLE = (
    "# Code review — highest-risk hunks first\n\nReview the following diff hunks, **in order** — they are ranked most-risky-first by {name}'s heuristics "
    "(size, changed surface, and dangerous patterns). Each hunk lists *why* it was flagged. Focus your attention on the earlier, higher-risk hunks; "
    "call out real bugs, security issues, and risky changes."
)
# Terminal colours.
COLOURS = {"gulp": "1;31", "sip": "33", "savor": "32"}

_LEAST = dict(TIERS)


def _chosen(values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("tier"))


def _text(*parts: Column | str | int) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _plural(n: Column, word: str) -> Column:
    return F.when(n == 1, word).otherwise(word + "s")


def location() -> Column:
    return _text(F.col("file_path"), ":", F.col("new_start"))


def _completed(documents: DataFrame, diffs: DataFrame | None, empty: str) -> DataFrame:
    if diffs is None:
        return documents
    return diffs.select("diff_id").join(documents, "diff_id", "left").select("diff_id", F.coalesce("document", F.lit(empty)).alias("document"))


def _in_rank(rows: Column, of: str = "row") -> Column:
    """Collected structs (rank, row) as their rows in order."""
    return F.transform(F.array_sort(rows), lambda x: x[of])


# ---- JSON


def _json_fields() -> Column:
    return F.struct("id", F.col("file_path").alias("file"), "old_start", "new_start", "added", "removed", "score", "raw", "signals")


def json_rows(hunks: DataFrame) -> DataFrame:
    """diff_id, rank, json: one object for each hunk."""
    return hunks.select("diff_id", "rank", F.to_json(_json_fields()).alias("json"))


def json_documents(hunks: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """diff_id, document: an array of a diff's hunks, ranked."""
    per = hunks.groupBy("diff_id").agg(F.to_json(_in_rank(F.collect_list(F.struct("rank", _json_fields().alias("row"))))).alias("document"))
    return _completed(per, diffs, "[]")


# ---- text menu


def bar(full: str = "#", rest: str = " ") -> Column:
    cells = F.least(F.lit(BAR_CELLS), F.greatest(F.lit(0), F.bround(F.col("score") / 100 * BAR_CELLS).cast("int")))
    return F.concat(F.repeat(F.lit(full), cells), F.repeat(F.lit(rest), F.lit(BAR_CELLS) - cells))


def text_rows(hunks: DataFrame) -> DataFrame:
    """diff_id, rank, label, score, bar, why: location and reasons, not yet wrapped."""
    reasons = F.when(F.size("signals") == 0, f"({QUIET})").otherwise(why())
    return hunks.select("diff_id", "rank", _chosen(LABEL).alias("label"), "score", _text("[", bar(), "]").alias("bar"), _text(location(), "  ", reasons).alias("why"))


def wrapped(text: Column, width: Column) -> Column:
    """Lines of at most ``width`` characters, broken at white space only; a longer word is a line of its own."""
    spaced = F.regexp_extract_all(F.translate(text, "\t\n\x0b\x0c\r", "     "), F.lit(r"( *)([^ ]+)"), 0)
    word = lambda x: F.ltrim(x)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def put(s: Column, x: Column) -> Column:
        fits = (s["line"] == "") | (F.char_length(s["line"]) + F.char_length(x) <= width)
        first = (s["line"] == "") & (F.size(s["done"]) > 0)
        return F.struct(
            F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["line"])).alias("done"),
            F.when(fits & ~first, F.concat(s["line"], x)).otherwise(word(x)).alias("line"),
        )

    return F.aggregate(spaced, start, put, lambda s: F.array_append(s["done"], s["line"]))


def _head_counts(of_files: str = "files") -> list[Column]:
    return [F.count("*").alias("n"), F.countDistinct("file_path").alias(of_files), F.max("score").alias("top")]


def folded(text: Column, width: Column) -> Column:
    """As ``wrapped``, and a longer word goes on in the next line."""
    def cut(x: Column) -> Column:
        n = F.floor((F.char_length(x) - 1) / width).cast("int")
        return F.when(F.char_length(x) <= width, F.array(x)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.substring(x, i * width + 1, width)))

    return F.flatten(F.transform(wrapped(text, width), cut))


def _painted(x: Column | str, code: Column | str) -> Column:
    return F.concat(F.lit("\x1b["), F.lit(code) if isinstance(code, str) else code, F.lit("m"), F.lit(x) if isinstance(x, str) else x, F.lit("\x1b[0m"))


def _with_cut(listed: Column, cut: Column, said: Column) -> Column:
    """The rows with a line after those within the budget; none where all or none are within."""
    at = cut.cast("int")
    return F.when((at > 0) & (at < F.col("n")), F.concat(F.slice(listed, 1, at), F.array(said), F.slice(listed, at + 1, F.size(listed)))).otherwise(listed)


def menu(hunks: DataFrame, budget: Budget | None = None, width: int = WIDTH, color: bool = False, diffs: DataFrame | None = None, name: str = NAME, model: TimeModel = TimeModel()) -> DataFrame:
    """diff_id, document: the ranked menu for a terminal, with a cut line where ``hunks`` are marked by ``within``.

    With ``color`` it is a table with columns and terminal colours; the words are the same.
    """
    total_width = max(LEAST_WIDTH, width)
    n = F.count("*").over(Window.partitionBy("diff_id"))  # the rows of one diff, which is a row of the source
    index_width = F.greatest(F.lit(2), F.length(n.cast("string")))
    rows = hunks.withColumns({"_n": n, "_index": index_width})
    reasons = F.when(F.size("signals") == 0, f"({QUIET})").otherwise(why())
    place = F.lpad(F.col("rank").cast("string"), F.col("_index"), F.lit(" "))
    score = F.lpad(F.col("score").cast("string"), 3, " ")
    if color:
        gutter = F.col("_index") + (3 + 4 + 3 + 3 + 3 + BAR_CELLS + 3)
        why_width = F.greatest(F.lit(LEAST_WHY), F.lit(total_width) - gutter)
        rule = gutter + why_width
        hue = _chosen(COLOURS)
        full = F.regexp_replace(bar("█", "░"), "(░+)", "\x1b[2m$1")
        cells = [place, _painted(_chosen(LABEL), hue), _painted(score, hue), _painted(full, hue)]
        lines = folded(_text(location(), "  ", reasons), why_width)
        blank = F.concat(F.repeat(F.lit(" "), F.col("_index")), *[F.lit(" │ " + " " * w) for w in (4, 3, BAR_CELLS)])
        first = lambda x: F.when(F.startswith(x, location()), F.concat(_painted(location(), "1"), F.substring(x, F.char_length(location()) + 1, F.char_length(x)))).otherwise(x)
        row = F.array_join(F.transform(lines, lambda x, i: F.concat_ws(" │ ", *[F.when(i == 0, c).otherwise(F.lit(None)) for c in cells], F.when(i > 0, blank), F.when(i == 0, first(x)).otherwise(x))), "\n")
    else:
        gutter = F.col("_index") + (2 + 2 + 4 + 2 + 3 + 2 + BAR_CELLS + 2 + 2)
        why_width = F.greatest(F.lit(LEAST_WHY), F.lit(total_width) - gutter)
        rule = F.least(F.lit(MOST_RULE), gutter + why_width)
        left = _text("  ", place, "  ", _chosen(LABEL), "  ", score, "  ", _text("[", bar(), "]"), "  ")
        lines = wrapped(_text(location(), "  ", reasons), why_width)
        row = F.concat(left, F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.repeat(F.lit(" "), gutter), x))), "\n"))
    columns = [row.alias("row"), "diff_id", "rank", "file_path", "score", F.col("_index").alias("index"), rule.alias("rule")]
    aggregates = [*_head_counts(), F.first("index").alias("index"), F.first("rule").alias("rule"), F.collect_list(F.struct("rank", "row")).alias("rows")]
    if budget is not None:
        columns += [F.when(F.col("reviewed"), 1).otherwise(0).alias("above"), F.when(F.col("reviewed"), model.seconds()).otherwise(0.0).alias("seconds")]
        aggregates += [F.sum("above").alias("cut"), F.sum("seconds").alias("spent")]
    per = rows.select(*columns).groupBy("diff_id").agg(*aggregates)
    listed, index = _in_rank(F.col("rows")), F.col("index").cast("int")
    if budget is not None:
        spec = _text("budget ", F.col("cut"), " of ", F.col("n"), " hunks") if budget.hunks is not None else _text("budget ", duration(F.lit(float(budget.seconds or 0))), " · ≈", duration(F.col("spent")), " above")
        said = _text("review ", F.col("cut"), " above · skim ", F.col("n") - F.col("cut"), " below · ", spec)
        if color:
            said = F.concat_ws(" │ ", _painted(F.lpad(F.lit("──"), index, F.lit(" ")), "1;36"), _painted("CUT ", "1;36"), _painted("───", "36"), _painted("─" * BAR_CELLS, "36"), _painted(said, "36"))
        else:
            said = F.concat(F.lit("─ cut: "), said, F.lit(" "))
            said = F.rpad(said, F.greatest(F.col("rule"), F.char_length(said)), F.lit("─"))
        listed = _with_cut(listed, F.col("cut"), said)
    summary = _text(f"🍷 {name} — ", F.col("n"), " ", _plural(F.col("n"), "hunk"), " across ", F.col("files"), " ", _plural(F.col("files"), "file"), " · top risk ", F.col("top"))
    tiers = [F.lit(label.strip()) for label in LABEL.values()]
    if color:
        summary = _painted(summary, "3")
        heads = [F.lpad(F.lit("#"), index, F.lit(" ")), F.lit("TIER"), F.lit("SCR"), F.lit(f"{'RISK':<{BAR_CELLS}}"), F.lit("WHY")]
        table_head = F.concat_ws(" ┃ ", *[_painted(h, "1") for h in heads])
        widths = [index, F.lit(4), F.lit(3), F.lit(BAR_CELLS), (F.col("rule") - index - (3 + 4 + 3 + 3 + 3 + BAR_CELLS + 3)).cast("int")]
        line = F.concat_ws("━╇━", *[F.repeat(F.lit("━"), w) for w in widths])
        tiers = [_painted(t, COLOURS[k]) for k, t in zip(LABEL, tiers, strict=True)]
    else:
        table_head = _text("  ", F.lpad(F.lit("#"), index, F.lit(" ")), "  TIER  SCR  ", f"{'RISK':<{BAR_CELLS + 2}}", "  WHY")
        line = F.repeat(F.lit("─"), F.col("rule").cast("int"))
    legend = _text("Tiers: ", tiers[0], f" (read first, ≥{_LEAST['gulp']}) · ", tiers[1], f" (read, ≥{_LEAST['sip']}) · ", tiers[2], f" (skim-safe, <{_LEAST['sip']}).  Listed most-risky-first.")
    parts = F.concat(F.array(summary, table_head, line), listed, F.array(legend)) if color else F.concat(F.array(summary, F.lit(""), table_head, line), listed, F.array(F.lit(""), legend))
    return _completed(per.select("diff_id", F.array_join(parts, "\n").alias("document")), diffs, f"{name} — nothing to taste (0 hunks). Pipe a diff to get a menu.")


# ---- Markdown


def _cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "[\r\n]", " ")


def markdown_rows(hunks: DataFrame) -> DataFrame:
    """diff_id, rank, tier, file_path, score, row: lines of a reading list."""
    reasons = F.when(F.size("signals") == 0, f"_{QUIET}_").otherwise(_cell(why()))
    row = _text("| [ ] | ", F.col("rank"), " | ", _chosen(EMOJI), " ", F.col("tier"), " | ", F.col("score"), " | `", _cell(location()), "` | ", reasons, " |")
    return hunks.select("diff_id", "rank", "tier", "file_path", "score", row.alias("row"))


def marker(name: str = NAME) -> str:
    """A hidden first line, by which a tool finds its own comment again."""
    return f"<!-- {name}:review-menu -->"


def markdown(hunks: DataFrame, title: str | None = None, fail_over: int | None = None, diffs: DataFrame | None = None, name: str = NAME) -> DataFrame:
    """diff_id, document: what to read, what may be skimmed behind a fold, and the gate's verdict."""
    item = F.struct("rank", "row")
    per = markdown_rows(hunks).groupBy("diff_id").agg(
        *_head_counts(), F.collect_list(F.when(F.col("tier") != "savor", item)).alias("read"), F.collect_list(F.when(F.col("tier") == "savor", item)).alias("skim"),
    )
    lead = f"{marker(name)}\n## {title or f'🍷 {name} — review-order menu'}\n\n"
    n, files, top = F.col("n"), F.col("files"), F.col("top")
    head = _text(lead, "**", n, " ", _plural(n, "hunk"), "** across **", files, " ", _plural(files, "file"), "** · top risk **", top, "**\n\n### Read these first\n\n")
    table = lambda c: _text(TABLE_HEAD, "\n", F.array_join(_in_rank(F.col(c)), "\n"), "\n")
    reading = F.when(F.size("read") > 0, _text("_In recommended reading order, most-risky-first._\n\n", table("read"), "\n")).otherwise("_Nothing rises above skim level — the whole diff is low-risk._ 🎉\n\n")
    skims = F.size("skim")
    fold = F.when(skims > 0, _text("<details>\n<summary>🟢 Skim-safe · ", skims, " ", _plural(skims, "hunk"), " (low risk)</summary>\n\n", table("skim"), "\n</details>\n\n")).otherwise("")
    gate = F.lit("")
    if fail_over is not None:
        tripped = _text("> ⛔ **CI gate:** a hunk scored **", top, f"** (≥ `{fail_over}`). Make sure it gets a real read before merging.\n\n")
        gate = F.when(top >= fail_over, tripped).otherwise(_text("> ✅ **CI gate:** top risk **", top, f"** is under the `{fail_over}` threshold.\n\n"))
    legend = f"<sub>Tiers: 🔴 gulp (read first, ≥{_LEAST['gulp']}) · 🟡 sip (read, ≥{_LEAST['sip']}) · 🟢 savor (skim-safe, <{_LEAST['sip']}). Ranked by risk + surprise · {name}</sub>"
    return _completed(per.select("diff_id", F.concat(head, reading, fold, gate, F.lit(legend)).alias("document")), diffs, f"{lead}_Nothing to taste — no hunks in this diff._ 🥂")


# ---- SARIF


def sarif_results(hunks: DataFrame) -> DataFrame:
    """diff_id, rank, rule_id, level, message, uri, start_line, end_line, score, tier, hunk_id."""
    first = F.get(F.filter("signals", lambda s: s["points"] > 0), F.lit(0))["rule"]
    start = F.greatest(F.lit(1), F.col("new_start"))
    span = F.when(F.col("new_lines") == 0, 1).otherwise(F.col("new_lines"))
    message = F.when(F.size("signals") == 0, SAFE_MESSAGE).otherwise(F.array_join(F.transform("signals", lambda s: s["reason"]), "; "))
    return hunks.select(
        "diff_id", "rank", F.coalesce(first, F.lit(SAFE_RULE)).alias("rule_id"), _chosen(LEVEL).alias("level"), message.alias("message"), F.col("file_path").alias("uri"),
        start.alias("start_line"), (start + span - 1).alias("end_line"), "score", "tier", F.col("id").alias("hunk_id"),
    )


def sarif(hunks: DataFrame, title: str | None = None, fail_over: int | None = None, diffs: DataFrame | None = None, name: str = NAME, version: str = "0.1.0", information_uri: str | None = None) -> DataFrame:
    """diff_id, document: a SARIF log for each diff, with a result for each hunk and a catalogue of their rules."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct("uri").alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    bag = F.struct("score", "tier", F.col("hunk_id").alias("hunkId"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), bag.alias("properties"))
    texts = F.create_map(*[F.lit(x) for kv in RULE_TEXTS.items() for x in kv])
    rule = lambda r: F.struct(r.alias("id"), r.alias("name"), F.struct(F.coalesce(F.try_element_at(texts, r), r).alias("text")).alias("shortDescription"))
    per = sarif_results(hunks).groupBy("diff_id").agg(
        _in_rank(F.collect_list(F.struct("rank", result.alias("row")))).alias("results"), F.transform(F.array_sort(F.collect_set("rule_id")), rule).alias("rules")
    )
    if diffs is not None:
        per = diffs.select("diff_id").join(per, "diff_id", "left")
        per = per.select("diff_id", *[F.coalesce(c, F.array().cast(per.schema[c].dataType)).alias(c) for c in ("results", "rules")])
    about = [F.lit(name).alias("name")] + ([F.lit(information_uri).alias("informationUri")] if information_uri else [])
    run = [F.struct(F.struct(*about, "rules", F.lit(version).alias("version")).alias("driver")).alias("tool"), F.col("results")]
    properties = ([F.lit(title).alias("title")] if title is not None else []) + ([F.lit(fail_over).alias("failOver")] if fail_over is not None else [])
    if properties:
        run.append(F.struct(*properties).alias("properties"))
    log = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(F.struct(*run)).alias("runs"))
    return per.select("diff_id", F.to_json(log).alias("document"))


# ---- bundle for a model


def bundle_blocks(hunks: DataFrame) -> DataFrame:
    """Ranked hunks with block, the text of each in a bundle for a model, and its tokens."""
    reasons = F.when(F.size("signals") == 0, QUIET).otherwise(why())
    body = F.regexp_replace("body", r"\n+\z", "")
    block = _text("### ", F.col("rank"), ". ", location(), " — ", F.col("tier"), " (risk ", F.col("score"), ")\nwhy: ", reasons, "\n\n```diff\n", header(), "\n", body, "\n```")
    return hunks.withColumn("block", block).withColumn("tokens", tokens(F.col("block")))


def block_cost() -> Column:
    """Tokens of a block and of the blank line after it."""
    return F.col("tokens") + 2


def bundle(marked: DataFrame, title: str | None = None, diffs: DataFrame | None = None, name: str = NAME) -> DataFrame:
    """diff_id, document: the blocks that a budget takes (``within`` over ``bundle_blocks``, at ``block_cost``)."""
    per = marked.groupBy("diff_id").agg(F.collect_list(F.when(F.col("reviewed"), F.struct("rank", F.col("block").alias("row")))).alias("blocks"), F.count("*").alias("n"))
    n, taken = F.col("n"), F.size("blocks")
    lead = PREAMBLE.replace("{name}", name) + (f"\n\n**Stated intent:** {title.strip()}" if title else "")
    left = n - taken
    reached = _text("_Budget reached: showing the ", taken, " highest-risk of ", n, " hunks; ", left, " lower-risk ", _plural(left, "hunk"), " omitted._")
    end = F.when(left > 0, reached).otherwise(_text("_All ", n, " ", _plural(n, "hunk"), " fit within the budget._"))
    document = _text(lead, "\n\n", F.array_join(_in_rank(F.col("blocks")), "\n\n"), "\n\n", end)
    return _completed(per.select("diff_id", document.alias("document")), diffs, f"{lead}\n\n_No hunks in this diff — nothing to review._")
