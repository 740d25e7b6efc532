"""Line dedup with a log-template tree, in DataFrame functions only.

A line is split at blanks; tokens that hold a digit are variable fields. The tree has a
fixed depth: lines go by token count, then by their first ``LEAD`` tokens, to a leaf.
Lines that agree in all but variable fields share a template.

Lines whose own template does not recur are generalised once more inside their leaf. A
token's support is the number of the leaf's distinct lines that hold it at its place.
``FIXED`` of a line's tokens, those of the most support, are its constants, together with
any other token of no less support; the rest are variable. Lines of a leaf with the same
constants share a general template, so a leaf holds as many templates as its lines give,
and neither other templates nor ordinary lines beside them outvote one.

A template recurs if it appears in ``LEAST`` families of documents. Copies of one
document, near ones too, are a family, not a recurrence, and however many there are they
count once: a document is compared with others by a sketch of the pieces of all its lines
but the tested one, and those of ``ALIKE`` estimated Jaccard or more to a family's first
member belong to it. Families are set aside one by one, so the work per template is
linear in its documents. What recurs by chance depends on length: for a template of
``LONG`` tokens or more two documents with next to nothing else in common are enough
(below ``APART``, by sketches of ``SHOWN`` hashes or more), and one of fewer than
``SHORT`` tokens must, besides, be in ``SHORT_MORE`` different documents outside the
families set aside. Every line of a recurring template is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import scratch, stage

LEAD = 3
LEAST = 4
#: Tokens below which a line recurs by chance in any large corpus, and different documents it must be in besides.
SHORT = 5
SHORT_MORE = 12
#: Tokens from which two unlike documents are enough.
LONG = 30
#: Jaccard similarity of the other lines from which two documents count as copies, and below which as unlike.
ALIKE = 0.4
APART = 0.25
SHOWN = 4
#: Hashes, of two documents together, of lines that are no candidates, from which these count; a share below which they are no copies' lines.
OWN_SHOWN = 10
OWN_APART = 0.15
#: Share of a line's tokens that are constants of its general template at least.
FIXED = 0.75
#: Hashes in a document's sketch, and at most of one line: a tested line leaves room for the others.
SKETCH = 28
OF_LINE = 4
#: Lines are cut into pieces at this letter, so that an edit changes one or two; shorter ones are left out where a line has longer.
CUT = "d"
PIECE_BYTES = 12
#: Rows of keys, or of documents with lines to drop, up to which a table is broadcast (some 40 MB); more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: The same for rows that hold a sketch.
BROADCAST_SKETCHES = 50_000

#: Runs of blanks other than a single space; tokens that hold a digit, found from their first character.
_BLANKS = " [ \\t\\r\\f\\x0B]+|[\\t\\r\\f\\x0B][ \\t\\r\\f\\x0B]*"
_FIELD = "(?<![^ ])[^ 0-9]*[0-9][^ ]*"


def _masked(line: Column) -> Column:
    """The line with single blanks and masked fields; most lines need no pattern for that."""
    line = F.trim(line)
    odd = line.rlike("[0-9\\t\\r\\f\\x0B]") | (F.instr(line, "  ") > 0)
    return F.when(odd, F.regexp_replace(F.trim(F.regexp_replace(line, _BLANKS, " ")), _FIELD, "<*>")).otherwise(line)


def _few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, broadcast where it is small."""
    return F.broadcast(df) if df.count() <= rows else df


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, template (masked line), tokens, key (of the template), leaf; of the lines that are not blank."""
    rows = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc_id", "pos", _masked(F.col("line")).alias("template")).filter("template <> ''")
    rows = rows.withColumn("tokens", F.octet_length("template") - F.octet_length(F.replace("template", F.lit(" "), F.lit(""))) + 1)
    return rows.withColumn("key", F.xxhash64("template")).withColumn("leaf", F.xxhash64("tokens", F.substring_index("template", " ", LEAD)))


def document_sketches(docs: DataFrame) -> DataFrame:
    """doc_id, sketch: the least hashes of the pieces of a document's lines, each with its line's position."""

    def of_line(line: Column, pos: Column) -> Column:
        cut = F.filter(F.split(line, CUT), lambda x: F.octet_length(x) >= PIECE_BYTES)
        pieces = F.when(F.size(cut) > 0, cut).otherwise(F.array(line))
        least = F.slice(F.sort_array(F.array_distinct(F.transform(pieces, lambda x: F.substring(F.md5(x.cast("binary")), 1, 15)))), 1, OF_LINE)
        return F.transform(least, lambda h: F.struct(h.alias("h"), pos.alias("pos")))

    lines = F.split(F.col("text").cast("string"), "\n", -1)
    marks = F.flatten(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", of_line(x, i)).otherwise(F.array().cast("array<struct<h:string,pos:int>>"))))
    number = lambda e: F.struct(F.conv(e["h"], 16, 10).cast("long").alias("h"), e["pos"].alias("pos"))
    return docs.filter("doc_id is not null and text is not null").select("doc_id", F.transform(F.slice(F.sort_array(marks), 1, SKETCH), number).alias("sketch"))


def with_rests(uses: DataFrame, sketches: DataFrame, key: str, *more: DataFrame) -> DataFrame:
    """(key, tokens, doc_id, rest), stored: what documents hold besides their lines of the key, what of it is their own, and the hash it reaches to.

    A document's own lines are those that are neither in ``uses`` nor in ``more`` (doc_id,
    pos). Uses are gathered by document, no more than its lines, and meet its sketch once.
    """
    rows = uses.select("doc_id", "pos", F.col(key).alias("key"), "tokens")
    for other in more:
        rows = rows.unionByName(other.select("doc_id", "pos"), allowMissingColumns=True)
    held = rows.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "key", "tokens")).alias("held")).join(sketches, "doc_id")

    def mark(e: Column) -> Column:
        here = F.filter("held", lambda u: u["pos"] == e["pos"])
        return F.struct(e["h"].alias("h"), F.transform(here, lambda u: u["key"]).alias("keys"))

    hashes = lambda marks: F.array_distinct(F.transform(marks, lambda m: m["h"]))
    reach = F.when(F.size("sketch") < SKETCH, F.lit((1 << 63) - 1)).otherwise(F.element_at("sketch", -1)["h"])
    keys = F.array_distinct(F.transform(F.filter("held", lambda u: u["key"].isNotNull()), lambda u: F.struct(u["key"].alias("key"), u["tokens"].alias("tokens"))))
    held = held.select("doc_id", reach.alias("reach"), keys.alias("uses"), F.transform("sketch", mark).alias("marks"))
    held = held.select("doc_id", "reach", "marks", hashes(F.filter("marks", lambda m: F.size(m["keys"]) == 0)).alias("own"), F.explode("uses").alias("use"))
    others = hashes(F.filter("marks", lambda m: ~F.coalesce(F.array_contains(m["keys"], F.col("use.key")), F.lit(False))))
    return stage(held.select(F.col("use.key").alias(key), F.col("use.tokens").alias("tokens"), "doc_id", F.struct(others.alias("hashes"), "reach", "own").alias("rest")), "uses")


def recurring(uses: DataFrame, key: str) -> DataFrame:
    """Keys of ``uses`` (key, tokens, doc_id, rest), a stored table, that appear in enough families of documents; stored."""
    left, found = uses, []
    for k in range(LEAST - 1):
        # a key in fewer documents than families are missing is out
        needed = F.when(F.col("tokens") >= LONG, 2 - min(k, 1)).otherwise(LEAST - k)
        first = left.groupBy(key, "tokens").agg(F.min(F.struct("doc_id", "rest")).alias("first"), F.count("*").alias("n")).filter(F.col("n") >= needed)
        first = stage(first.select(key, F.col("first.doc_id").alias("first_id"), F.col("first.rest").alias("first")), f"firsts-{k}")
        left = left.join(_few(first, BROADCAST_SKETCHES), key).filter("doc_id <> first_id")
        reach = F.least("rest.reach", "first.reach")
        left = left.withColumn("x", F.filter("rest.hashes", lambda h: h <= reach)).withColumn("y", F.filter("first.hashes", lambda h: h <= reach))
        left = left.withColumn("common", F.size(F.array_intersect("x", "y"))).withColumn("any", F.size("x") + F.size("y") - F.col("common"))
        x_own, y_own = (F.filter(f"{side}.own", lambda h: h <= reach) for side in ("rest", "first"))
        left = left.withColumn("own", F.size(x_own) + F.size(y_own)).withColumn("own_common", F.size(F.array_intersect(x_own, "y")) + F.size(F.array_intersect(y_own, "x")))
        left = left.filter((F.col("common") < ALIKE * F.col("any")) | ((F.col("own") >= OWN_SHOWN) & (F.col("own_common") < OWN_APART * F.col("own"))))
        unlike = (F.col("common") < APART * F.col("any")) & (F.least(F.size("x"), F.size("y")) >= SHOWN)
        left = stage(left.select(key, "tokens", "doc_id", "rest", unlike.alias("unlike")), f"families-{k}")
        found.append(left.filter((F.col("tokens") >= LONG) & F.col("unlike")).select(key))
    found.append(left.filter(F.col("tokens") >= SHORT).select(key))
    short = left.filter(F.col("tokens") < SHORT).select(key, "rest.hashes").distinct().groupBy(key).count()
    found.append(short.filter(F.col("count") >= SHORT_MORE).select(key))
    return stage(reduce(DataFrame.union, found).distinct(), "recurring")


def templates_of(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(leaf, key, tokens, template) of ``lines`` (doc_id, pos, leaf, key, tokens): only their documents are split."""
    wanted = lines.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "leaf", "key", "tokens")).alias("wanted"))  # no more than a document's lines
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = texts.join(_few(stage(wanted, "wanted"), BROADCAST_SKETCHES), "doc_id").select(F.split("text", "\n", -1).alias("lines"), "wanted")
    found = found.select("lines", F.explode("wanted").alias("w")).select("w.*", _masked(F.get("lines", F.col("w.pos"))).alias("template"))
    # rows that repeat a doc_id with another text have another line there
    return found.filter(F.xxhash64("template") == F.col("key")).dropDuplicates(["leaf", "key"]).select("leaf", "key", "tokens", "template")


def general_templates(lines: DataFrame) -> DataFrame:
    """(leaf, key, group) of the distinct ``lines`` (leaf, key, tokens, template) whose constants others share; group stands for these."""
    words = lines.select("leaf", "key", "tokens", F.posexplode(F.split("template", " ")).alias("at", "token")).filter(F.col("at") >= LEAD)
    supports = stage(words.groupBy("leaf", "at", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST), "supports")
    place = F.struct("n", "at", "token")
    held = words.join(_few(supports), ["leaf", "at", "token"]).groupBy("leaf", "key", "tokens").agg(F.sort_array(F.collect_list(place), asc=False).alias("held"))
    # the leading tokens are constants of every line in the leaf
    needed = (F.ceil(FIXED * F.col("tokens")) - LEAD).cast("int")
    held = held.filter(F.size("held") >= needed)
    least = F.element_at("held", needed)["n"]
    constants = F.sort_array(F.transform(F.filter("held", lambda e: e["n"] >= least), lambda e: F.struct(e["at"].alias("at"), e["token"].alias("token"))))
    return held.select("leaf", "key", F.xxhash64("leaf", constants).alias("group"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos): the lines of recurring templates. ``docs`` (doc_id, text) is read more than once."""
    marks = stage(document_lines(docs).drop("template"), "lines")
    sketches = stage(document_sketches(docs), "sketches")
    # aggregates and joins are stored apart: only then can Spark split the join of a very common line, and combine its uses before dealing them
    often = marks.groupBy("key", "tokens").agg(F.count("*").alias("n")).filter(F.col("n") >= F.when(F.col("tokens") >= LONG, 2).when(F.col("tokens") >= SHORT, LEAST).otherwise(LEAST - 1 + SHORT_MORE))
    often = stage(often.select("key"), "often")
    candidates = marks.join(_few(often), "key", "left_semi")
    exact = recurring(with_rests(candidates, sketches, "key"), "key")
    first = marks.join(_few(exact), "key", "left_semi").select("doc_id", "pos")

    rest = marks.filter(F.col("tokens") >= SHORT).join(_few(exact), "key", "left_anti")
    leaves = rest.groupBy("leaf", "key").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("leaf")
    members = stage(rest.join(_few(stage(leaves, "leaves")), "leaf", "left_semi"), "members")
    groups = stage(general_templates(stage(templates_of(members.dropDuplicates(["leaf", "key"]), docs), "leaf-lines")), "groups")
    several = stage(groups.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("group"), "several")
    groups = stage(groups.join(_few(several), "group", "left_semi"), "general")
    fitting = stage(members.join(_few(groups), ["leaf", "key"]).select("group", "tokens", "doc_id", "pos"), "fitting")
    general = recurring(with_rests(fitting, sketches, "group", candidates), "group")
    return first.union(fitting.join(_few(general), "group", "left_semi").select("doc_id", "pos"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rid of the lines of recurring templates, and line counts n_lines and n_dropped.

    Only DataFrame functions. Lines end at newlines; blank ones stay. Rows keep their
    other columns as they are (an own n_lines or n_dropped is replaced); rows without a
    dropped line keep their text byte for byte, null included. doc_id is the key: rows
    that repeat one lose the lines that either loses at its position, and do not count as
    another document. A null doc_id has no lines dropped and counts for none. Very long
    texts and lines are treated whole. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession, "lost") as keep:
        lost = keep(dropped_lines(docs).distinct())
    gone = stage(lost.groupBy("doc_id").agg(F.collect_list("pos").alias("__gone_lines")).withColumnRenamed("doc_id", "__gone_from"), "dropped")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("__gone_lines", i))
    gone = F.broadcast(gone) if lost.count() <= BROADCAST_ROWS else gone
    out = docs.drop("n_lines", "n_dropped").join(gone, F.col("doc_id") == F.col("__gone_from"), "left")
    out = out.withColumn("n_lines", F.size(lines)).withColumn("n_dropped", F.greatest(F.coalesce(F.size("__gone_lines"), F.lit(0)), F.lit(0)))
    out = out.withColumn("text", F.when(F.col("__gone_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.drop("__gone_lines", "__gone_from")


def _round(k: int, name: str) -> str:
    """CTEs of one family set aside, over left_{name}{k} (key, tokens, doc_id, hashes, reach, own)."""
    return f"""
firsts_{name}{k} AS (
  SELECT key, min(doc_id) AS first_id FROM left_{name}{k} GROUP BY key, tokens HAVING count(*) >= CASE WHEN tokens >= {LONG} THEN {2 - min(k, 1)} ELSE {LEAST - k} END
), pairs_{name}{k} AS (
  SELECT l.key, l.tokens, l.doc_id, l.hashes, l.reach, l.own,
    list_filter(l.hashes, lambda h: h <= least(l.reach, f.reach)) AS x, list_filter(f.hashes, lambda h: h <= least(l.reach, f.reach)) AS y,
    list_filter(l.own, lambda h: h <= least(l.reach, f.reach)) AS x_own, list_filter(f.own, lambda h: h <= least(l.reach, f.reach)) AS y_own
  FROM left_{name}{k} l JOIN firsts_{name}{k} s ON l.key = s.key JOIN left_{name}{k} f ON f.key = s.key AND f.doc_id = s.first_id WHERE l.doc_id <> s.first_id
), left_{name}{k + 1} AS (
  SELECT key, tokens, doc_id, hashes, reach, own, common < {APART} * (len(x) + len(y) - common) AND least(len(x), len(y)) >= {SHOWN} AS unlike
  FROM (SELECT *, len(list_intersect(x, y)) AS common FROM pairs_{name}{k}) WHERE common < {ALIKE} * (len(x) + len(y) - common)
    OR (len(x_own) + len(y_own) >= {OWN_SHOWN} AND len(list_intersect(x_own, y)) + len(list_intersect(y_own, x)) < {OWN_APART} * (len(x_own) + len(y_own)))
)"""


def _recurring(name: str) -> str:
    """CTEs from left_{name}0 to recurring_{name} (key)."""
    rounds = ",".join(_round(k, name) for k in range(LEAST - 1))
    far = " UNION ".join(f"SELECT key FROM left_{name}{k + 1} WHERE tokens >= {LONG} AND unlike" for k in range(LEAST - 1))
    return f"""{rounds}, recurring_{name} AS (
  {far} UNION SELECT key FROM left_{name}{LEAST - 1} WHERE tokens >= {SHORT}
  UNION SELECT key FROM left_{name}{LEAST - 1} WHERE tokens < {SHORT} GROUP BY key HAVING count(DISTINCT hashes) >= {SHORT_MORE}
)"""


def _rests(uses: str, name: str, key: str, candidates: str) -> str:
    return f"""
shared_{name} AS (
  SELECT doc_id, list(DISTINCT pos) AS shared FROM ({candidates}) GROUP BY doc_id
), held_{name} AS (
  SELECT {key} AS key, doc_id, max(tokens) AS tokens, list(pos) AS places FROM {uses} GROUP BY {key}, doc_id
), left_{name}0 AS (
  SELECT key, tokens, doc_id, list_distinct(list_transform(list_filter(sketch, lambda e: NOT list_contains(places, e.pos)), lambda e: e.h)) AS hashes,
    CASE WHEN len(sketch) < {SKETCH} THEN 'g' ELSE sketch[-1].h END AS reach,
    list_distinct(list_transform(list_filter(sketch, lambda e: NOT list_contains(shared, e.pos)), lambda e: e.h)) AS own
  FROM held_{name} JOIN sketches USING (doc_id) JOIN shared_{name} USING (doc_id)
)"""


#: The same in DuckDB's SQL, over documents; the constants are those above.
ORACLE_SQL = rf"""
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), cut AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line,
    unnest(list_transform(parts, lambda x: regexp_replace(trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g'))) AS template
  FROM raw
), uses AS MATERIALIZED (
  SELECT doc_id, pos, template, len(string_split(template, ' ')) AS tokens,
    len(string_split(template, ' ')) || ' ' || array_to_string(string_split(template, ' ')[1:{LEAD}], ' ') AS leaf
  FROM cut WHERE template <> ''
), pieces AS (
  SELECT doc_id, pos, line, list_filter(string_split(line, '{CUT}'), lambda x: strlen(x) >= {PIECE_BYTES}) AS long FROM cut WHERE trim(line) <> ''
), hashes AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_transform(CASE WHEN len(long) > 0 THEN long ELSE [line] END, lambda x: md5(x)[1:15])))[1:{OF_LINE}] AS h FROM pieces
), sketches AS MATERIALIZED (
  SELECT doc_id, list(struct_pack(h := h, pos := pos) ORDER BY h, pos)[1:{SKETCH}] AS sketch FROM (SELECT doc_id, pos, unnest(h) AS h FROM hashes) GROUP BY doc_id
), often AS (
  SELECT template FROM uses GROUP BY template, tokens
  HAVING count(*) >= CASE WHEN tokens >= {LONG} THEN 2 WHEN tokens >= {SHORT} THEN {LEAST} ELSE {LEAST - 1 + SHORT_MORE} END
), candidates AS (
  SELECT * FROM uses SEMI JOIN often USING (template)
),{_rests("candidates", "a", "template", "SELECT doc_id, pos FROM candidates")},{_recurring("a")}, rest AS MATERIALIZED (
  SELECT * FROM uses WHERE tokens >= {SHORT} AND template NOT IN (SELECT key FROM recurring_a)
), distinct_lines AS (
  SELECT DISTINCT leaf, template, tokens FROM rest
), full_leaves AS (
  SELECT leaf FROM distinct_lines GROUP BY leaf HAVING count(*) >= {LEAST}
), words AS (
  SELECT leaf, template, tokens, unnest(range(tokens)) AS place, unnest(string_split(template, ' ')) AS token FROM distinct_lines SEMI JOIN full_leaves USING (leaf)
), supports AS (
  SELECT leaf, template, tokens, place, token, count(*) OVER (PARTITION BY leaf, place, token) AS n FROM words WHERE place >= {LEAD}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY leaf, template ORDER BY n DESC, place DESC) AS nth FROM supports WHERE n >= {LEAST}
), limits AS (
  SELECT leaf, template, n AS fewest FROM ranked WHERE nth = CAST(ceil({FIXED} * tokens) AS INTEGER) - {LEAD}
), groups AS (
  SELECT leaf, template, leaf || ' ' || string_agg(place || ':' || token, ' ' ORDER BY place) AS grp FROM ranked JOIN limits USING (leaf, template) WHERE n >= fewest GROUP BY leaf, template
), fitting AS (
  SELECT grp, tokens, doc_id, pos FROM rest JOIN groups USING (leaf, template) WHERE grp IN (SELECT grp FROM groups GROUP BY grp HAVING count(*) >= {LEAST})
),{_rests("fitting", "b", "grp", "SELECT doc_id, pos FROM candidates UNION SELECT doc_id, pos FROM fitting")},{_recurring("b")}, gone AS (
  SELECT doc_id, pos FROM uses WHERE template IN (SELECT key FROM recurring_a) UNION SELECT doc_id, pos FROM fitting WHERE grp IN (SELECT key FROM recurring_b)
), per_doc AS (
  SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text,
  CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""
