import random

import cases
from sleuthflow.llm import substring


def plain(rows, least):
    """Repeats by a dictionary of normalised units, in rank order."""
    found = []
    for n, (key, text) in enumerate(rows):
        for line, start, end, words, _ in substring.units_of(text or "", least):
            found.append(((key is None, key if key is not None else 0, start, line), n, line, start, end, words, " ".join(text[start:end].lower().split())))
    first, again = {}, []
    for unit in sorted(found, key=lambda u: u[0]):
        if unit[6] in first:
            again.append(unit)
        else:
            first[unit[6]] = unit
    out = []
    for u in again:
        lines = [w[4] for w in again if w[1] == u[1] and w[2] == u[2] and w[3] == w[2]]
        until = max(lines, default=-1)
        if not ((u[3] > u[2] or u[4] < until) and u[4] <= until):
            out.append((rows[u[1]][0], u[3], u[4], u[5], rows[first[u[6]][1]][0], first[u[6]][3]))
    return sorted(out, key=repr)


def test_units_keep_offsets():
    text = "One two three. Four  FIVE six!\n\n  seven eight nine"
    got = [(text[s:e], n) for _, s, e, n, _ in substring.units_of(text, 3)]
    assert got == [("One two three. Four  FIVE six!", 6), ("One two three.", 3), ("Four  FIVE six!", 3), ("  seven eight nine", 3)]


def test_repeats_equal_a_dictionary(spark):
    rng = random.Random(2)
    sentences = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))).capitalize() + "." for _ in range(40)]
    rows = []
    for k in range(120):
        lines = [" ".join(rng.choice(sentences) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4))]
        rows.append((k, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = substring.repeated(df, least=3).drop("copy").collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows, 3)


def test_passages_go_and_clean_rows_stay(spark):
    passage = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(3, f"Own start here.\n{passage}\nOwn end."), (1, f"First holder. {passage} Tail of it."), (2, "clean text " * 8), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (row,) = substring.repeated(df).collect()
    assert (row["doc_id"], row["kept_doc_id"], row["n_words"]) == (3, 1, 60)
    assert rows[0][1][row["start"] : row["end"]] == passage
    after = {r["doc_id"]: r["text"] for r in substring.without_repeats(df).collect()}
    assert after == {3: "Own start here.\n\nOwn end.", 1: rows[1][1], 2: rows[2][1], 4: None}


def test_short_lines_and_wrapped_paragraphs_are_found(spark):
    rows = [(1, "short line\n\n这是一行中文文字\n\none two three four\nfive six seven"), (2, "own\n\nshort line\n\n这是一行中文文字\n\none two\nthree four five six\nseven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {rows[1][1][r["start"] : r["end"]] for r in substring.repeated(df).collect()}
    assert found == {"short line", "这是一行中文文字", "one two\nthree four five six\nseven"}


def test_a_repeated_row_covers_its_own_sentences_only(spark):
    first, second = (" ".join(f"{c}{k}" for k in range(12)) + "." for c in "st")
    rows = [(1, first), (2, f"{first} {second}"), (2, f"{first} {second}")]
    found = substring.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = len(rows[1][1])
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in found) == [(2, 0, len(first)), (2, 0, whole)]


def test_rows_of_all_kinds(spark):
    rows = [r[:2] for r in cases.TEXTS]
    found = substring.repeated(cases.documents(spark, True)).collect()
    assert len(found) == len(plain(rows, substring.LEAST_WORDS)) == 2
    assert substring.repeated(cases.nothing(spark)).count() == 0
    assert substring.without_repeats(cases.documents(spark, True)).count() == len(rows)
