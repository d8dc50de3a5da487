"""Alignment, resampling and line-first cleaning against plain code, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np

from hunkwise.llm import alignment, cleaning, resampling
from hunkwise.llm import queries as q
from hunkwise.llm.shelf import Shelf

SF = "/root/testdata/sf0.001"
A, B = q.tokenizer_file("byte_bpe_50k.json"), q.tokenizer_file("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "  two  spaces ", "line\nline\r\n\ttab\x0b", "<|endoftext|> and </s> are text", "it's DON'T we've", "日本語 のテキスト 🙂🙂", "\x00 \x1f\x7f x\x85y \xa0z　",
    "holds ▁ a sign", "▁", "0x41 <0x41>", "été é", "9" * 3000, "word " * 2000, "ab" * 4000, " ".join(str(i) for i in range(3000)),
]


def spelt(tokens):
    out, n = [], 0
    for t in tokens:
        n += len(t)
        out.append(n)
    return out


def plain_alignment(rows):
    """As the contract says it, a text at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    letters = alignment.byte_letters()
    counts, per = collections.Counter(), []
    for doc_id, text in rows:
        links, groups, ids, pieces = [], [], [], []
        if text:
            want, coded = f" {text}".encode(), a_of.encode(f" {text}", add_special_tokens=False)
            ids, pieces = coded.ids, b_of.encode(text)
            of_a = [bytes(letters[c] for c in t) for t in coded.tokens]
            of_b = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_of.id_to_piece(i)) for i in pieces)]
            if b"".join(of_a) == want == b"".join(of_b):
                ends_a, ends_b = spelt(of_a), spelt(of_b)
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    own_a = [x for x in range(i, len(ids)) if ends_a[x] <= end] if len(ids) < 50 else list(range(i, ends_a.index(end, i) + 1))
                    own_b = list(range(j, ends_b.index(end, j) + 1))
                    i, j = own_a[-1] + 1, own_b[-1] + 1
                    groups.append(",".join(str(ids[x]) for x in own_a) + "|" + ",".join(str(pieces[x]) for x in own_b))
                    links += [(ids[x], pieces[y]) for x in own_a for y in own_b if ends_a[x] == ends_b[y]]
            else:
                ids, pieces = [], []
        counts.update(links)
        per.append((doc_id, len(ids), len(pieces), groups, links))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted([(d, na, nb, len(g), len(k), sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k), digest(g)) for d, na, nb, g, k in per], key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_alignment_by_brute_force(spark):
    docs = [tuple(r) for r in q.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert rows_of(q.op11_alignment(spark, SF)) == plain_alignment(docs)


def test_alignment_of_odd_texts_over_many_chunks(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "y", 2), (None, "null id", "z", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, chunk string, code int").repartition(5)
    assert rows_of(alignment.align(frame, A, B)) == plain_alignment([r[:2] for r in rows])
    assert alignment.align(frame.where("false"), A, B).count() == 0
    # without the broadcast of pairs
    before, alignment.BROADCAST_PAIRS = alignment.BROADCAST_PAIRS, 0
    try:
        assert rows_of(alignment.align(frame, A, B)) == plain_alignment([r[:2] for r in rows])
    finally:
        alignment.BROADCAST_PAIRS = before


def test_units_are_coded_as_texts_are():
    aligner, rng = alignment.Aligner(A, B, remembered=50), random.Random(4)
    pool = list("ab cdEF  \n\t\r\x0b\x1c\x85\xa0 ' 's't12é日🙂▁.,!?\x00") + ["<|endoftext|>", " ", "the", " <0x0A>"]
    assert aligner.by_units
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
        units = aligner.units(text)
        aligner.learn(dict.fromkeys(u for u in units if u not in aligner.known))
        own, whole = [aligner.known[u] for u in units], aligner.whole([text])[0]
        assert (None in own and whole is None) or whole == (sum(u[0] for u in own), sum(u[1] for u in own), b"".join(u[2] for u in own), ";".join(u[3] for u in own))
        if len(aligner.known) > 50:
            aligner.learn(())


def test_links_are_expanded_once_per_group(spark):
    frame = spark.createDataFrame([(i, "the same words again") for i in range(500)], "doc_id long, text string").repartition(4)
    linked = alignment.links(alignment.aligned_chunks(frame, A, B, Shelf(spark)))
    assert {r.n for r in linked.collect()} == {500} and linked.count() == linked.select("group").distinct().count()


def test_crc32_of_words_and_pairs():
    rng = random.Random(1)
    texts = ["Aa b", "", "x" * 300 + " é " + "Y" * 70, *("".join(rng.choice("aB1é -.\n") for _ in range(rng.randrange(80))) for _ in range(60))]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for n in (1, 2, 3):
        _, doc, bucket = resampling.features(data, offs, n, 10_000)
        got, want = collections.Counter(zip(doc.tolist(), bucket.tolist())), collections.Counter()
        for i, t in enumerate(texts):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            want.update((i, zlib.crc32(" ".join(words[j : j + k]).encode()) % 10_000) for k in range(1, n + 1) for j in range(len(words) - k + 1))
        assert got == want


def test_resampling_by_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.sql(q.ORACLE_SQL["op12_resampling"]).fetchall()
    assert rows_of(q.op12_resampling(spark, SF)) == sorted(want, key=repr)


def test_resampling_ranks_and_edge_cases(spark):
    long = "word " * 30
    rows = [(i, long, 7, 1) for i in range(60)] + [(5, long, 8, 2), (None, long, 0, 0), (61, None, 0, 0), (62, "", 0, 0), (63, "few words", 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int, rank int").repartition(7)
    target = spark.createDataFrame([("word other",), (None,)], "text string")
    out = resampling.resample(frame, target, per_100=50).collect()
    assert len(out) == len(rows)
    drawn = sorted((r.rank, -r.score, math.inf if r.doc_id is None else r.doc_id) for r in out if r.rank)
    assert [r[0] for r in drawn] == list(range(1, 32)) and drawn == sorted(drawn, key=lambda r: r[1:])
    least = drawn[-1][1:]
    assert all((-r.score, math.inf if r.doc_id is None else r.doc_id) >= least for r in out if r.rank is None and r.n_features >= 20)
    assert {(r.n_features, r.weight, r.rank) for r in out if r.doc_id in (61, 62)} == {(0, 0, None)}
    assert resampling.resample(frame.where("false"), target).count() == 0
    assert resampling.resample(frame, target.where("false"), ngram=2).where("rank is not null").count() == 6


def test_cleaning_by_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(q.ORACLE_SQL["op13_cleaning"]).fetchall()
    assert rows_of(q.op13_cleaning(spark, SF)) == sorted(want, key=repr)


def test_lines_that_fail():
    fails = {
        "Home | About | Contact | Log in": True, "a, | b | c": True, "Read more": True, "Home is where the heart is.": False, "All rights reserved. Nobody is allowed to copy.": True,
        "THE!! HOUSE!! IS!! RED!!": True, "What?! It was red, and it was far away.": False, "a#b c$ d% e": True, "One sentence ends here.": False, 'He said "so."': False,
        "one two three, four five six seven": False, "one two three four": True, "end…” ": False,
    }
    assert {line: cleaning.judge_lines(line).n_failed_lines == 1 for line in fails} == fails
    got = cleaning.judge_lines("Same line here.\n\n \t\nSame line here.\nSame line here. \nNot|this")
    assert got == (12 * 0 + 13 * 3 + 8, 1, 1, 2, 13 + 8, "Same line here.\n\n \t\nSame line here. ")


def test_cleaning_edge_cases(spark):
    good = " ".join(f"w{i}" for i in range(25)) + ", and so on."
    block = " ".join(f"v{i}" for i in range(8))
    rows = [(1, good, "a", True), (2, None, "a", True), (3, "", "a", True), (4, " \n", "a", True), (5, "few words.", "a", True), (6, f"{good}\n" + "x | y | z\n" * 40, "a", True),
            (7, f"{good} {' '.join(f'u{i}.' for i in range(20))} {block} {block}", "a", True), (8, f"{block}. " * 9, "a", True), (9, good.upper().replace("W", "w"), "a", True), (9, good, "a", True), (None, good, "a", True), (10, f"{good}\nSubscribe to this.", "a", True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, clean_text string, kept boolean")
    out = cleaning.clean(frame).collect()
    assert {r.doc_id for r in out if r.kept} == {None, 1, 9, 10} | {7} and len(out) == len(rows)
    of = {r.doc_id: r for r in out}
    assert of[7].n_repeat_words == 16 and of[7].clean_text is not None and of[8].base_failed
    assert of[10].clean_text == good and of[10].lost_chars == 16
    assert (of[2].n_words, of[2].clean_text, of[2].base_failed, of[3].clean_text) == (0, None, True, "")
    assert cleaning.clean(frame.where("false")).count() == 0
