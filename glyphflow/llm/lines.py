"""Line dedup by a log-template tree, in DataFrame functions only.

A line's words with a digit become "<*>". The tree has a fixed depth: the
number of tokens, then the leading tokens; what reaches the same leaf is
alike. At a leaf, lines that agree with its most common tokens in enough
places share one template, the other places being variable. The rest of the
leaf is parted by the token at its most telling place, that of several tokens
of which the fewest stand in one line only (the first such place), and each
part is treated in the same way, until a part holds one line or none that is
rare. So a leaf may have any number of templates; one whose variable place
happens to be the telling one is found for each token there by itself. A line
that joined no other is its own template, and lines of few tokens are compared
as they are, digits included. A template that occurs in several documents is
recurring: its lines stay in the document with the smallest key and are dropped
elsewhere. Documents with equal texts count as one, so that copies of a whole
document do not make its lines recur; finding those is another operator's work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.frames import sent_if_small, stored


@dataclass(frozen=True)
class Rules:
    """Shape of the tree, and from when on a template recurs."""

    leading: int = 3
    # Shorter lines recur only as they are.
    min_tokens: int = 4
    similarity: float = 0.8
    min_docs: int = 2
    # A table of templates up to this many rows (24 bytes each) is sent to all tasks; a longer one is joined by shuffle.
    max_sent_rows: int = 300_000
    # The same for parts of leaves, whose rows are as long as a line.
    max_sent_parts: int = 10_000


def spaced(line: Column) -> Column:
    """Tokens of a line, one space between."""
    # Most lines need no change, and the tests are much cheaper than the changes.
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """Tokens of a line, one space between, those with a digit as <*>."""
    plain = spaced(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(plain)


def _lines(docs: DataFrame, key: str, text: str, rules: Rules) -> DataFrame:
    """Document, text hash, place, number of tokens, leaf, line template and masked line of every line; none of a blank one."""
    split = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    out = split.select("doc", "version", "place", "line", masked(F.col("line")).alias("masked")).where("masked <> ''")
    tokens = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    out = out.select("*", tokens.alias("tokens"))
    leaf = F.xxhash64("tokens", F.substring_index("masked", " ", rules.leading))
    own = F.when(F.col("tokens") < rules.min_tokens, F.xxhash64(spaced(F.col("line")))).otherwise(F.xxhash64("masked"))
    return out.select("doc", "version", "place", "tokens", leaf.alias("leaf"), own.alias("own"), "masked")


def _mixed(strings: DataFrame, part: str, rules: Rules) -> DataFrame:
    """Parts that hold several line strings, one of them rare by itself and all of them together not."""
    parts = strings.groupBy(part).agg(F.count("*").alias("n"), F.sum("docs").alias("all"), F.count_if(F.col("docs") < rules.min_docs).alias("rare"))
    return parts.where((F.col("n") > 1) & (F.col("all") >= rules.min_docs) & (F.col("rare") > 0)).select(part)


def _members(docs: DataFrame, lines: DataFrame, key: str, text: str, rules: Rules) -> DataFrame:
    """Leaf, line template and shared template of the lines that share one with others of their leaf."""
    # A line of a few tokens has no place that may vary.
    able = lines.where((F.col("tokens") >= rules.min_tokens) & (F.col("tokens") - 1 >= rules.similarity * F.col("tokens")))
    texts = able.groupBy("leaf", "own", "version").agg(F.min("doc").alias("doc"))
    strings = texts.groupBy("leaf", "own").agg(F.count("*").alias("docs"), F.min("doc").alias("example"))
    strings = stored(strings, "line-strings")
    mixed = stored(strings.join(_mixed(strings, "leaf", rules), "leaf", "left_semi"), "line-leaves")
    # Only the first document with a string is read again for its tokens.
    examples = stored(mixed.select(F.col("example").alias(key)).distinct(), "line-examples")
    some = docs.select(key, text).join(sent_if_small(examples, rules.max_sent_rows), key, "left_semi")
    full = _lines(some, key, text, rules).select("leaf", "own", "masked").join(sent_if_small(mixed, rules.max_sent_rows), ["leaf", "own"])
    full = full.groupBy("leaf", "own").agg(F.min("masked").alias("masked"), F.max("docs").alias("docs"))
    level = stored(full.select("leaf", F.col("leaf").alias("part"), "own", "docs", F.split("masked", " ", -1).alias("words")), "line-tokens")
    found = level.where("false").select("leaf", "own", F.col("part").alias("shared"))
    # Each level leaves every part with fewer strings than before: some join, or the place that parts them has several tokens.
    while not level.isEmpty():
        judged = stored(_judged(level, rules), "line-level")
        found = found.union(judged.where("joins").select("leaf", "own", F.col("part").alias("shared")))
        rest = judged.where("not joins").select("leaf", F.col("below").alias("part"), "own", "docs", "words")
        level = stored(rest.join(_mixed(rest, "part", rules), "part", "left_semi").select(*level.columns), "line-tokens")
    return found


def _judged(level: DataFrame, rules: Rules) -> DataFrame:
    """Line strings, whether they join the template of their part, and the part below that they belong to otherwise."""
    tokens = level.select("part", "docs", F.posexplode("words").alias("place", "token"))
    tokens = tokens.groupBy("part", "place", "token").agg(F.sum("docs").alias("docs"), F.count("*").alias("n"))
    places = tokens.groupBy("part", "place").agg(
        F.max_by("token", F.struct("docs", "token")).alias("common"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
    template = F.transform(F.sort_array(F.collect_list(F.struct("place", "common"))), lambda x: x["common"])
    telling = F.min(F.when(F.col("kinds") > 1, F.struct("single", "place")))["place"]
    parts = stored(places.groupBy("part").agg(template.alias("template"), telling.alias("telling")), "line-parts")
    same = F.size(F.filter(F.zip_with("words", "template", lambda a, b: a == b), lambda x: x))
    joins = same >= rules.similarity * F.size("words")
    below = F.xxhash64("part", "telling", F.get("words", F.col("telling")))
    return level.join(sent_if_small(parts, rules.max_sent_parts), "part").select(*level.columns, joins.alias("joins"), below.alias("below"))


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of `docs` with recurring lines taken out of `text`; two columns `n_lines` and `n_dropped` at the end.

    Lines are parted by newlines, tokens by white space; lines with fewer than
    `min_tokens` tokens recur only as equal tokens, and blank lines always stay.
    A text without dropped lines is unchanged,
    a null text stays null with no lines, and a text may become empty. Rows with
    equal texts are treated alike; a null key comes after all others. All
    columns but `text` pass through, and columns called `n_lines` or
    `n_dropped` are replaced.
    """
    rules = rules or Rules()
    lines = stored(_lines(docs, key, text, rules).drop("masked"), "lines")
    members = stored(_members(docs, lines, key, text, rules), "line-members")
    lines = lines.join(sent_if_small(members, rules.max_sent_rows), ["leaf", "own"], "left")
    # The template of a line: the one it shares, or the line's own within the leaf.
    lines = lines.withColumn("own", F.coalesce("shared", "own")).drop("shared")
    texts = lines.groupBy("leaf", "own", "version").agg(F.min("doc").alias("doc"))
    counts = texts.groupBy("leaf", "own").agg(F.count("*").alias("docs"), F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "version")).alias("first"))
    recurring = counts.where(F.col("docs") >= rules.min_docs).select("leaf", "own", F.col("first.version").alias("first"))
    # Stored, so that it is counted cheaply, and so that a hot template is split where it has to be joined by shuffle.
    recurring = sent_if_small(stored(recurring, "line-recurring"), rules.max_sent_rows)
    dropped = lines.join(recurring, ["leaf", "own"]).where(F.col("version") != F.col("first"))
    dropped = dropped.groupBy("doc", "version").agg(F.collect_set("place").alias("dropped"))
    names = [str(i) for i in range(len(docs.columns))]
    own, told = names[docs.columns.index(key)], names[docs.columns.index(text)]
    whole = docs.toDF(*names).withColumn("hash", F.xxhash64(told))
    joined = whole.join(dropped, F.col(own).eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("version")), "left")
    parts = F.split(told, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    counts = [F.when(F.col(told).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped")]
    columns = [F.when(F.col("dropped").isNull(), F.col(told)).otherwise(kept) if n == told else F.col(n) for n in names]
    out = joined.select(*(c.alias(f"c{n}") for c, n in zip(columns, names, strict=True)), *counts)
    taken = [n for n, c in zip(names, docs.columns, strict=True) if c not in ("n_lines", "n_dropped")]
    return out.select(*(F.col(f"c{n}").alias(docs.columns[int(n)]) for n in taken), "n_lines", "n_dropped")
