r"""Quotation linking of conversations, with DataFrame functions only.

A line's quote level is the number of ``>`` in its leading run of ``>`` and blanks.  A quoted passage is a maximal run of lines of one
level of 1 or more.  Passages are normalised (markers off, A-Z and other letters lower-cased, runs of white space to one
space, trimmed), hashed, and joined within the conversation to what messages say without quotes: the whole body, each
paragraph (between blank lines) and each line.  A passage's original is the earliest turn before the quoting one that says
it.  With ``parts``, a passage that no message says as a whole is looked for by its paragraphs (between bare markers) and its lines, and its
original is the latest one of theirs; it counts once in ``n_quoted`` and ``n_linked``.  A message's parent is the latest
original of its level-1 passages; deeper levels give ``n_linked`` only.  Parents lead to
``thread_turn``, the first message of the reply chain, and ``depth``, by pointer doubling: the number of rounds is the logarithm of
the longest chain, and all joins are on (conversation, turn), so that a conversation of a third of all rows stays spread out.

Result, a row per message, in order of (conversation, thread_turn, turn): replies follow what they answer.  ``body`` is the text
without quoted lines, trimmed; ``rendered`` is the message in chat markup.  Null texts are empty; a message without a
linked quote starts a thread of its own.  An empty table gives no rows; further columns don't matter.  Rows that repeat a (conversation, turn) are kept, each with its own text; as an
original, the turn counts once.  Messages with a null conversation or turn are kept and linked with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut, sibling

QUOTE = r"^[ \t]*(?:>[ \t]*)+"
ANY_QUOTE = r"(?m)^[ \t]*>"
BLANKS = "[ \\t\\x0B\\f\\r\\n]+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[ \\t]", ""))


def normal(passage: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(passage, BLANKS, " ")))


def _hash(passage: Column) -> Column:
    return F.sha2(normal(passage), 256)


def _body(text: Column) -> Column:
    """The text without quoted lines, without white space at both ends."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(QUOTE))
    own = F.when(text.rlike(ANY_QUOTE), F.array_join(lines, "\n")).otherwise(text)
    return F.regexp_replace(own, "^[ \\t\\x0B\\f\\r\\n]+|[ \\t\\x0B\\f\\r\\n]+$", "")


def _cut_up(passage: Column) -> Column:
    """The paragraphs and the lines of a text."""
    return F.array_union(F.split(passage, "\\n[ \\t\\r]*\\n", -1), F.split(passage, "\n", -1))


def _passages(quoting: DataFrame, parts: bool) -> DataFrame:
    """(conv, turn, key, run, level, pos, hash) of each quoted passage: at pos 0 the whole, then, with ``parts``, its paragraphs and lines."""
    lines = quoting.select("conv", "turn", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("conv", "turn", "key", "pos", _level(F.col("line")).alias("level"), F.regexp_replace("line", QUOTE, "").alias("line"))
    own = Window.partitionBy("conv", "turn", "key").orderBy("pos")  # the lines of one message
    lines = lines.withColumn("new", F.coalesce((F.lag("level").over(own) != F.col("level")).cast("int"), F.lit(1)))
    lines = lines.withColumn("run", F.sum("new").over(own)).where("level > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    runs = lines.groupBy("conv", "turn", "key", "run", "level").agg(text.alias("passage"))
    runs = runs.where(normal(F.col("passage")) != "")
    forms = F.array_union(F.array("passage"), _cut_up(F.col("passage"))) if parts else F.array("passage")
    each = runs.select("conv", "turn", "key", "run", "level", F.posexplode(forms).alias("pos", "form")).where(normal(F.col("form")) != "")
    return each.select("conv", "turn", "key", "run", "level", "pos", _hash(F.col("form")).alias("hash"))


def _originals(said: DataFrame) -> DataFrame:
    """(conv, hash, first): the first turn that says a body, paragraph or line."""
    parts = F.array_union(F.array("body"), _cut_up(F.col("body")))
    each = said.select("conv", "turn", F.explode(F.array_distinct(parts)).alias("part")).where(normal(F.col("part")) != "")
    return each.select("conv", "turn", _hash(F.col("part")).alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("first"))


def _roots(links: DataFrame) -> DataFrame:
    """(conv, turn, thread_turn, depth) for links (conv, turn, parent_turn), by pointer doubling."""
    now = links.select("conv", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        then = now.join(above, ["conv", "up"], "left")
        then = cut(then.select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")), "threads")
        moved = not then.where("moved").isEmpty()
        now = then.drop("moved")
        if not moved:
            return now.withColumnRenamed("up", "thread_turn")


def threads(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts: bool = False) -> DataFrame:
    """conv_id, turn, role, parent_turn, thread_turn, depth, n_quoted (passages), n_linked, body, rendered."""
    said = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    said = said.withColumn("body", _body(F.col("text"))).withColumn("key", F.when(F.col("text").rlike(ANY_QUOTE), F.sha2("text", 256)))
    quoting = said.where("key is not null and conv is not null and turn is not null").select("conv", "turn", "key", "text").distinct()
    passages = cut(_passages(quoting, parts), "passages")
    named = ["conv", "turn", "role", "body"]
    if passages.isEmpty():  # nothing quotes: no join is needed
        out = said.select(*named, *(F.lit(None).cast(said.schema["turn"].dataType).alias(n) for n in ("parent_turn", "thread")), *(F.lit(0).cast("long").alias(n) for n in ("depth", "n_quoted", "n_linked")))
    else:
        wanted = passages.select("conv", "hash").distinct()
        firsts = _originals(said.join(passages.select("conv").distinct(), "conv", "left_semi")).join(wanted, ["conv", "hash"], "left_semi")
        found = passages.join(firsts, ["conv", "hash"], "left").withColumn("first", F.when(F.col("first") < F.col("turn"), F.col("first")))
        whole, part = (F.max(F.when(c, F.col("first"))) for c in (F.col("pos") == 0, F.col("pos") > 0))
        found = found.groupBy("conv", "turn", "key", "run", "level").agg(F.coalesce(whole, part).alias("first"))
        per = cut(found.groupBy("conv", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("first"))).alias("parent_turn"), F.count("*").alias("n_quoted"), F.count("first").alias("n_linked")), "links")
        links = per.where("parent_turn is not null")
        roots = _roots(links).withColumnRenamed("thread_turn", "thread")
        out = said.join(per.join(roots, ["conv", "turn"], "left"), ["conv", "turn"], "left").select(*named, "parent_turn", "thread", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("n_quoted", F.lit(0).cast("long")).alias("n_quoted"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"))
    out = out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "parent_turn", F.coalesce("thread", "turn").alias("thread_turn"),
        "depth", "n_quoted", "n_linked", "body", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("<|end|>")).alias("rendered"),
    )
    return out.orderBy(conv_col, "thread_turn", turn_col)


def op9_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(sibling(spark, sf_dir, "conversations"), parts=True)


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of conversations in which each message quotes the two before it, one level deeper for the earlier one."""
    said = sibling(spark, sf_dir, "conversations")
    for back in (1, 2):
        before = said.groupBy("conv_id", (F.col("turn") + back).alias("turn")).agg(F.min("text").alias(f"text_{back}"))
        said = said.join(before, ["conv_id", "turn"], "left")
    mark = lambda c, by: F.coalesce(F.concat(F.lit(by), F.replace(c, F.lit("\n"), F.lit("\n" + by)), F.lit("\n")), F.lit(""))
    text = F.concat(mark(F.col("text_2"), ">> "), mark(F.col("text_1"), "> "), F.lit("\n"), F.coalesce("text", F.lit("")))
    return threads(said.select("conv_id", "turn", "role", text.alias("text")))


OP9_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         regexp_matches(coalesce(text, ''), '(?m)^[ \t]*>') AS quotes FROM conversations
), bodies AS (
  SELECT conv_id, turn, role, text, quotes, regexp_replace(
    CASE WHEN quotes THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*(?:>[ \t]*)+')), chr(10)) ELSE text END,
    '^[ \t\x0B\f\r\n]+|[ \t\x0B\f\r\n]+$', '', 'g') AS body FROM said
), lines AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM said WHERE quotes
), levels AS (
  SELECT conv_id, turn, pos, length(regexp_replace(regexp_extract(raw, '^[ \t]*(?:>[ \t]*)+'), '[ \t]', '', 'g')) AS level,
         regexp_replace(raw, '^[ \t]*(?:>[ \t]*)+', '') AS line FROM lines
), starts AS (
  SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level THEN 1 ELSE 0 END AS new FROM levels WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM starts
), passages AS (
  SELECT conv_id, turn, level, trim(lower(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '[ \t\x0B\f\r\n]+', ' ', 'g'))) AS passage
  FROM runs WHERE level > 0 GROUP BY conv_id, turn, run, level
), parts AS (
  SELECT conv_id, turn, trim(lower(regexp_replace(part, '[ \t\x0B\f\r\n]+', ' ', 'g'))) AS passage FROM (
    SELECT conv_id, turn, unnest([body] || string_split_regex(body, '\n[ \t\r]*\n') || string_split(body, chr(10))) AS part FROM bodies)
), firsts AS (
  SELECT conv_id, passage, min(turn) AS first FROM parts GROUP BY ALL
), per AS (
  SELECT p.conv_id, p.turn, max(f.first) FILTER (p.level = 1 AND f.first < p.turn) AS parent_turn, count(*) AS n_quoted,
         count(f.first) FILTER (f.first < p.turn) AS n_linked
  FROM passages p LEFT JOIN firsts f USING (conv_id, passage) WHERE p.passage <> '' GROUP BY ALL
), walk AS (
  SELECT conv_id, turn, parent_turn AS up, 1 AS depth FROM per WHERE parent_turn IS NOT NULL
  UNION ALL
  SELECT w.conv_id, w.turn, p.parent_turn, w.depth + 1 FROM walk w JOIN per p ON p.conv_id = w.conv_id AND p.turn = w.up WHERE p.parent_turn IS NOT NULL
), roots AS (
  SELECT conv_id, turn, min(up) AS thread_turn, max(depth) AS depth FROM walk GROUP BY ALL
)
SELECT b.conv_id, b.turn, b.role, p.parent_turn, coalesce(r.thread_turn, b.turn) AS thread_turn, coalesce(r.depth, 0)::BIGINT AS depth,
       coalesce(p.n_quoted, 0) AS n_quoted, coalesce(p.n_linked, 0) AS n_linked, b.body,
       '<|' || coalesce(b.role, 'unknown') || '|>' || chr(10) || b.body || '<|end|>' AS rendered
FROM bodies b LEFT JOIN per p ON p.conv_id = b.conv_id AND p.turn = b.turn LEFT JOIN roots r ON r.conv_id = b.conv_id AND r.turn = b.turn
"""

_BEFORE = "SELECT conv_id, turn + {k} AS turn, min(text) AS text_{k} FROM conversations GROUP BY ALL"
_MARK = "coalesce('{by}' || replace({c}, chr(10), chr(10) || '{by}') || chr(10), '')"
QUOTED_THREADS_SQL = OP9_SQL.replace(
    "WITH RECURSIVE said AS (",
    f"""WITH RECURSIVE quoted AS (
  SELECT conv_id, turn, role, {_MARK.format(by=">> ", c="text_2")} || {_MARK.format(by="> ", c="text_1")} || chr(10) || coalesce(text, '') AS text
  FROM conversations LEFT JOIN ({_BEFORE.format(k=1)}) one USING (conv_id, turn) LEFT JOIN ({_BEFORE.format(k=2)}) two USING (conv_id, turn)
), said AS (""",
    1,
).replace("AS quotes FROM conversations", "AS quotes FROM quoted")
