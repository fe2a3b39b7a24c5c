import duckdb
import pandas as pd

from lodestone.llm.chat_threads import OP9_SQL, op9_chat_threads, threads

ROWS = [
    (1, 0, "user", "Hello there.\n\nHow do I   sort a LIST?"),
    (1, 1, "assistant", "> how do i sort a list?\nCall sort.\n\nOr sorted."),
    (1, 2, "user", "> > How do I sort a list?\n> Call sort.\nThat fails."),
    (1, 3, "assistant", ">Or sorted.\n> unknown words\nAnd this?"),
    (1, 4, "user", "> That fails.\n\n> and   this?\nYes."),
    (2, 0, "user", "Call sort."),
    (2, 1, None, "> \n>\nnothing quoted"),
    (2, 2, "user", "> > >Call sort.\nDeep."),
    (2, 3, "user", None),
    (2, 4, "user", ""),
    (2, 5, "user", "x > y\n" * 3),
    (3, 0, "user", "same\nsame"),
    (3, 1, "user", "> same\n"),
    (3, 2, "user", "> same\n"),
]


def rows(tuples):
    return sorted(map(repr, map(tuple, tuples)))


def test_matches_sql_with_quotes_null_and_empty(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    made = threads(df.withColumn("depth", df.turn).withColumn("first", df.role))
    got = made.toPandas()
    conversations = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    want = duckdb.sql(f"SELECT {', '.join(made.columns)} FROM ({OP9_SQL})").fetchall()
    assert rows(made.collect()) == rows(want)
    at = {(r.conv_id, r.turn): r for r in got.itertuples()}
    assert at[1, 2].parent_turn == 1 and at[1, 2].thread_turn == 0 and at[1, 2].depth == 2
    assert at[1, 4].parent_turn == 3 and at[1, 4].thread_turn == 3 and at[1, 4].depth == 1 and at[1, 4].body == "Yes."
    assert at[3, 2].parent_turn == 0


def test_long_chains_repeated_rows_nulls_and_empty_tables(spark):
    chain = [(9, 0, "u", "line 0")] + [(9, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 40)] + [(9, 39, "u", "> line 38\nline 39")]
    chain += [(None, 1, "u", "> line 0"), (9, None, "u", "> line 0"), (8, 0, "u", "word " * 100000)]
    got = threads(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).toPandas()
    assert len(got) == len(chain)
    mine = got[(got.conv_id == 9) & got.turn.notna()]
    assert (mine.depth == mine.turn).all() and (mine.thread_turn == 0).all()
    assert got[got.conv_id.isna() | got.turn.isna()].parent_turn.isna().all()
    assert threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


PARTIAL = [
    (1, 0, "user", "First thing.\nSecond thing.\nThird thing.\n\nNext paragraph\nover two lines.\n\nLast paragraph."),
    (1, 1, "assistant", "An answer."),
    (1, 2, "user", "> next paragraph over two\n> lines.\nNot said like that, nor a line of it."),
    (1, 3, "user", "> Next paragraph\n> over two lines.\n>\n> Last paragraph.\nTwo of three paragraphs."),
    (1, 4, "user", "> First thing.\n> second   thing.\nTwo of three lines."),
    (1, 5, "user", "> Third thing.\n> An answer.\nOf two messages."),
    (1, 6, "user", "> Two of three lines.\n> never said\nOne line is known."),
    (1, 7, "user", "> never said\n>\n> nor this\nNothing is known."),
    (1, 8, "user", "> > Last paragraph.\n> > never said\nOnly of a deeper level."),
]


def test_quotes_of_some_paragraphs_or_lines_are_linked(spark):
    df = spark.createDataFrame(PARTIAL, "conv_id long, turn long, role string, text string")
    at = {r["turn"]: r for r in threads(df, parts=True).collect()}
    assert {t: r["parent_turn"] for t, r in at.items()} == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: 1, 6: 4, 7: None, 8: None}
    assert {t: (r["n_quoted"], r["n_linked"]) for t, r in at.items() if t > 1} == {2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (1, 1), 6: (1, 1), 7: (1, 0), 8: (1, 1)}
    assert (at[6]["thread_turn"], at[6]["depth"]) == (0, 2) and (at[5]["thread_turn"], at[5]["depth"]) == (1, 1)
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    at = {(r["conv_id"], r["turn"]): r for r in threads(rows, parts=True).collect()}
    assert at[1, 3]["parent_turn"] == 1 and at[1, 4]["thread_turn"] == 0 and at[1, 4]["depth"] == 3


def test_the_query_links_partial_quotes(spark, tmp_path):
    spark.createDataFrame(PARTIAL, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["turn"]: r["parent_turn"] for r in op9_chat_threads(spark, str(tmp_path)).collect()}
    assert got[3] == 0 and got[4] == 0 and got[5] == 1
