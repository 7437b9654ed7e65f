"""Line deduplication by a suffix array over line-ID sequences (DataFrame operations only).

A document is the sequence of its non-blank lines (split at ``\\n``).  A run of consecutive lines with at least ``min_chars``
characters in all is a repeated run if the same lines also start at an earlier place (smaller doc_id, or same document and
smaller line number).  A single line of at least ``min_line`` characters is one, too, if it stands at ``frequent`` places or more.
Lines covered by the later copy of a repeated run are deleted; the first copy stays.

* A start of a repeated run has a repeated shortest qualifying run, so each suffix is sorted by its first ``need`` lines, the
  fewest that reach ``min_chars``.
* Lines get ranks in the order of their IDs.  Prefix doubling: the suffixes ranked by h lines are ranked by 2h lines through the
  pair (own rank, rank h lines further).  A rank is the number of suffixes that sort before; ranks of one group are refined by
  running totals over split groups, so neither a line nor a run that makes up a third of all rows meets in one task.
* Suffixes with the same first ``need`` lines form an interval of the suffix array whose longest common prefix is at least
  ``need``.  The interval's smallest place is the copy that stays; all other members are later copies.
* The longest repeated run at a start ends no later than the one at the next start, if that is a later copy too.  So only the last of
  adjoining later copies is carried on, within its interval: the next start has no copy, so less than ``min_chars`` characters
  can follow.  Each longer prefix in turn has its smallest place, and a later copy of it is covered.
* A suffix that meets a line without a second occurrence within its ``need`` lines has no copy and leaves the sort at once.
* Frequent lines are the large intervals of the order by one line; they need no further doubling.
* Texts are shuffled only where lines may go: a bitmap of at most ``_BITS`` bits, set by the documents with deletions, tells most
  others apart.  A bit that is set by chance costs a row in the join and changes nothing.

Documents are told apart by (doc_id, text hash).  Null texts stay null; empty texts, blank lines and documents without repeated
runs stay as they are; rows with equal doc_id and equal text are one document and are treated alike.  A null doc_id sorts first and
its documents are never changed.
An empty table gives an empty result.  All columns of the input are passed through; helper columns start with ``__``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadfield.llm.common import row_key, staged, totals_before

MIN_CHARS = 100
#: A line of so many characters goes from its later places if it has so many places or more.
MIN_LINE, FREQUENT = 20, 8
#: Bits of the bitmap of documents with deletions: 8 MB at any size of the corpus.
_BITS, _WORD = 1 << 26, 1 << 15
#: Places of one frequent line that meet its first place in one group of the join.
_SHARE = 4096
_PARTS = 1024
_DOC = ["doc_id", "__key"]


def lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, __key, no, pos, id, id2, chars, need): all lines by number ``no``, after one shuffle by document.

    ``pos`` counts non-blank lines; a blank line has the ``pos`` of the one before it and no ``id``.  ``need`` is the number of
    non-blank lines from here until ``min_chars`` characters are reached, null if the document ends before.
    """
    one = docs.select("doc_id", row_key(docs).alias("__key"), F.split("text", "\n", -1).alias("__ls")).filter(F.col("__ls").isNotNull())
    ids = F.transform("__ls", lambda x: F.struct(F.xxhash64(x).alias("id"), F.xxhash64(x, F.lit(1)).alias("id2"), F.when(F.length(F.trim(x)) > 0, F.char_length(x)).alias("chars")))
    one = one.select(*_DOC, ids.alias("__ls")).groupBy(*_DOC).agg(F.first("__ls").alias("__ls"))
    each = one.select(*_DOC, F.posexplode("__ls").alias("no", "l")).select(*_DOC, "no", "l.id", "l.id2", "l.chars")
    along = Window.partitionBy(*_DOC).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("*", (F.count("chars").over(along) - 1).alias("pos"), F.coalesce(F.sum(F.col("chars").cast("long")).over(along), F.lit(0)).alias("upto"))
    # a line's start asks for the first line whose end lies min_chars further: ends and asks in one descending order
    end = F.struct(F.col("upto").alias("at"), F.when(F.col("chars").isNotNull(), F.col("pos")).alias("end"), F.lit(1).alias("kind"))
    ask = F.struct((F.col("upto") - F.coalesce("chars", F.lit(0)) + min_chars).alias("at"), F.lit(None).cast("long").alias("end"), F.lit(2).alias("kind"))
    both = each.withColumn("e", F.explode(F.array(end, ask)))
    down = Window.partitionBy(*_DOC).orderBy(F.desc("e.at"), "e.kind", F.desc("no")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last", F.min("e.end").over(down)).filter("e.kind = 2")
    full = F.col("chars").isNotNull()
    return found.select(*_DOC, "no", "pos", F.when(full, F.col("id")).alias("id"), F.when(full, F.col("id2")).alias("id2"), "chars", F.when(full, F.col("last") - F.col("pos") + 1).alias("need"))


def _first_ranks(seq: DataFrame) -> DataFrame:
    """Lines that occur more than once, ranked by the number of such lines with a smaller ID."""
    groups = seq.groupBy("id", "id2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("part", F.shiftright("id", 54))
    ranks = totals_before(groups, [], "part", ["id", "id2"], "n", "rank").select("id", "id2", "rank", "n")
    return seq.join(ranks, ["id", "id2"]).select(*_DOC, "pos", "need", "rank", "chars", "n")


def _doubled(suffixes: DataFrame, h: int, size: int) -> DataFrame:
    """Ranks by 2h lines from ranks by h lines; suffixes whose second half is missing or that have no copy leave.

    Lines without a copy are not among the rows, so the row h further is the right one only if its ``pos`` says so.
    """
    along = Window.partitionBy(*_DOC).orderBy("pos")
    pairs = suffixes.withColumn("next", F.when(F.lead("pos", h).over(along) == F.col("pos") + h, F.lead("rank", h).over(along))).filter("next IS NOT NULL")
    groups = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("part", F.floor(F.col("next") * _PARTS / (size + 1)))
    ranks = totals_before(groups, ["rank"], "part", ["next"], "n", "less").filter("n > 1").select("rank", "next", (F.col("rank") + F.col("less")).alias("deeper"))
    return pairs.join(ranks, ["rank", "next"]).select(*_DOC, "pos", "need", F.col("deeper").alias("rank"))


def _longer_runs(members: DataFrame, singles: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, __key, pos, need): the runs beyond the shortest one that are later copies, at the last of adjoining later copies.

    ``members`` are the starts of all intervals, ``singles`` the lines that occur more than once by their first ranks.
    """
    key = ["h", "need", "rank", "tail"]
    doc = [F.col("doc_id").alias("__doc"), F.col("__key").alias("__k")]
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__k"))
    along = Window.partitionBy(*_DOC).orderBy("pos")
    more = (F.lead("pos").over(along) == F.col("pos") + 1) & F.lead("later").over(along)
    starts = members.withColumn("last", F.col("later") & ~F.coalesce(more, F.lit(False)))
    # the run of the next start has no earlier copy, so less than min_chars characters follow this start's first line
    after = singles.select(*doc, (F.col("pos") - 1).alias("__p"), F.coalesce("need", F.lit(min_chars)).alias("cap"))
    starts = starts.join(after, same & (F.col("pos") == F.col("__p"))).filter("cap > need").drop("__doc", "__k", "__p")
    wanted = starts.filter("last").select(*key).distinct()
    asks = starts.join(wanted, key, "left_semi").withColumn("at", F.explode(F.expr("sequence(pos + need, pos + cap - 1)")))
    found = asks.join(singles.select(*doc, F.col("pos").alias("__p"), F.col("rank").alias("line")), same & (F.col("at") == F.col("__p")))
    found = found.groupBy(*_DOC, "pos", "last", *key).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ls"))
    # only as far as no line is missing; a line without a second occurrence is
    found = found.withColumn("ls", F.expr("transform(filter(ls, (x, i) -> x.at = pos + need + i), x -> x.line)"))
    runs = F.expr("transform(sequence(1, size(ls)), j -> struct(j AS more, xxhash64(slice(ls, 1, j)) AS a, xxhash64(slice(ls, 1, j), 1) AS b))")
    found = staged(found.filter("size(ls) > 0").withColumn("x", F.explode(runs)).select(*_DOC, "pos", "last", *key, "x.*"))
    place = F.struct(*_DOC, "pos")
    key = [*key, "more", "a", "b"]
    firsts = found.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = found.filter("last").join(firsts, key).filter(place > F.col("first"))
    return later.select(*_DOC, "pos", (F.col("need") + F.col("more")).alias("need"))


def _frequent_lines(singles: DataFrame, min_line: int, frequent: int) -> DataFrame:
    """(doc_id, __key, pos, need): the later places of lines that stand at ``frequent`` places or more."""
    shares = F.ceil(F.col("n") / _SHARE)
    often = singles.filter((F.col("n") >= frequent) & (F.col("chars") >= min_line))
    often = often.select(*_DOC, "pos", "rank", "n", F.pmod(F.xxhash64(*_DOC, "pos"), shares).alias("share"))
    place = F.struct(*_DOC, "pos")
    firsts = often.groupBy("rank", "n").agg(F.min(place).alias("first"))
    # a line's first place is there once for each share of its places, so their number bounds a group, not the line's
    firsts = firsts.select("rank", "first", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    return often.join(firsts, ["rank", "share"]).filter(place > F.col("first")).select(*_DOC, "pos", F.lit(1).cast("long").alias("need"))


def repeated_runs(numbered: DataFrame, min_chars: int = MIN_CHARS, min_line: int = MIN_LINE, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, __key, pos, need): later copies whose union is that of all later copies; ``numbered`` is the staged ``lines``."""
    singles = staged(_first_ranks(numbered.filter("id IS NOT NULL").select(*_DOC, "pos", "id", "id2", "need", "chars")))
    levels = singles.select(*_DOC, "pos", "need", "rank")
    common = _frequent_lines(singles, min_line, frequent)
    top, size = levels.agg(F.max("need"), F.count(F.lit(1))).first()
    h, classes = 1, None
    while top is not None and h <= top:
        # need in [h, 2h): the first h and the last h lines together fix the run
        if h > 1:
            ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(0, h - 1)
            near = F.collect_list(F.struct("pos", "rank")).over(ahead)
            fixed = levels.withColumn("__b", near).withColumn("tail", F.expr(f"get(filter(__b, x -> x.pos = pos + need - {h}), 0).rank"))
        else:
            fixed = levels.withColumn("tail", F.col("rank"))
        fixed = fixed.filter(f"need >= {h} AND need < {2 * h} AND tail IS NOT NULL").select(*_DOC, "pos", "need", "rank", "tail", F.lit(h).alias("h"))
        classes = fixed if classes is None else classes.unionByName(fixed)
        if 2 * h <= top:
            levels = staged(_doubled(levels, h, size))
            top = levels.agg(F.max("need")).first()[0]
        h *= 2
    if classes is None:
        return common
    classes = staged(classes)
    place = F.struct(*_DOC, "pos")
    key = ["h", "need", "rank", "tail"]
    intervals = staged(classes.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    members = staged(classes.join(intervals, key).select(*_DOC, "pos", *key, (place > F.col("first")).alias("later")))
    return members.filter("later").select(*_DOC, "pos", "need").unionByName(_longer_runs(members, singles, min_chars)).unionByName(common)


def deleted_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_line: int = MIN_LINE, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, __key, __gone): for documents with deletions a flag for each line, true where it goes."""
    numbered = staged(lines(docs, min_chars))
    runs = repeated_runs(numbered, min_chars, min_line, frequent).select(*_DOC, "pos", "need", F.lit(-1).alias("no"), F.lit(False).alias("full"))
    rows = numbered.select(*_DOC, "pos", F.lit(None).cast("long").alias("need"), "no", F.col("id").isNotNull().alias("full")).unionByName(runs)
    along = Window.partitionBy(*_DOC).orderBy("pos", "no").rowsBetween(Window.unboundedPreceding, 0)
    reach = rows.withColumn("end", F.max(F.col("pos") + F.col("need")).over(along)).filter("no >= 0")
    flags = reach.select(*_DOC, F.struct("no", F.coalesce(F.col("full") & (F.col("pos") < F.col("end")), F.lit(False)).alias("gone")).alias("l"))
    listed = flags.groupBy(*_DOC).agg(F.max("l.gone").alias("any"), F.array_sort(F.collect_list("l")).alias("ls")).filter("any")
    return staged(listed.select(*_DOC, F.col("ls.gone").alias("__gone")))


def _place(doc, key):
    """(word, position) of a document in the bitmap."""
    bit = F.pmod(F.xxhash64(doc, key), F.lit(_BITS))
    return F.shiftright(bit, 15).cast("int"), F.pmod(bit, F.lit(_WORD)).cast("int")


def delete_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_line: int = MIN_LINE, frequent: int = FREQUENT) -> DataFrame:
    """The documents with ``text`` rid of later copies, and ``__lines_removed`` (0 where nothing went)."""
    gone = deleted_lines(docs, min_chars, min_line, frequent).select(F.col("doc_id").alias("__doc"), F.col("__key").alias("__k"), "__gone")
    word, at = _place(F.col("__doc"), F.col("__k"))
    bitmap = gone.groupBy(word.alias("__word")).agg(F.bitmap_construct_agg(at).alias("__bits"))
    keyed = docs.withColumn("__key", row_key(docs))
    word, at = _place(F.col("doc_id"), F.col("__key"))
    keyed = keyed.withColumns({"__word": word, "__at": at}).join(F.broadcast(bitmap), "__word", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__at", 3) + 1, 1)), 16, 10).cast("int")
    maybe = F.coalesce(F.bit_get(byte, F.pmod("__at", F.lit(8))) == 1, F.lit(False))
    keyed = keyed.withColumn("__maybe", maybe).drop("__word", "__at", "__bits")
    untouched = keyed.filter(~F.col("__maybe")).select(*docs.columns, F.lit(0).cast("long").alias("__lines_removed"))
    keyed = keyed.filter("__maybe")
    hit = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__k")), "left")
    # nulls are left out of the joined text
    kept = F.array_join(F.zip_with(F.split("text", "\n", -1), F.col("__gone"), lambda x, g: F.when(~g, x)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    removed = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size(F.filter("__gone", lambda g: g)))
    touched = hit.withColumn("__lines_removed", removed.cast("long")).withColumn("text", text)
    return untouched.unionByName(touched.select(*docs.columns, "__lines_removed"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; null text: empty)."""
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    source = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    out = delete_lines(source)
    return out.select("doc_id", "n_lines", F.col("__lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
     f AS (SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos,
                  sum(length(line)) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM l WHERE length(trim(line, ' ')) > 0),
     ends AS (SELECT a.doc_id, a.pos, (SELECT min(b.pos) FROM f b WHERE b.doc_id = a.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - length(a.line) + {MIN_CHARS}) AS last FROM f a),
     runs AS (SELECT e.doc_id, e.pos, e.last, string_agg(f.line, chr(10) ORDER BY f.pos) AS body
              FROM ends e JOIN f ON f.doc_id = e.doc_id AND f.pos BETWEEN e.pos AND e.last GROUP BY ALL),
     pairs AS (SELECT a.doc_id, a.pos, b.doc_id AS other, b.pos AS place FROM runs a JOIN runs b ON a.body = b.body AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)),
     stops AS (SELECT p.doc_id, p.pos, p.other, p.place, min(x.pos) FILTER (y.line IS DISTINCT FROM x.line) AS stop
               FROM pairs p JOIN f x ON x.doc_id = p.doc_id AND x.pos >= p.pos LEFT JOIN f y ON y.doc_id = p.other AND y.pos = p.place + x.pos - p.pos GROUP BY ALL),
     later AS (SELECT doc_id, pos, max(coalesce(stop, 1000000000)) AS stop FROM stops GROUP BY ALL),
     often AS (SELECT doc_id, no, count(*) OVER (PARTITION BY line) AS n, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS k FROM f WHERE length(line) >= {MIN_LINE}),
     gone AS (SELECT f.doc_id, f.no FROM later JOIN f ON f.doc_id = later.doc_id AND f.pos >= later.pos AND f.pos < later.stop
              UNION SELECT doc_id, no FROM often WHERE n >= {FREQUENT} AND k > 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS body FROM l ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id) k USING (doc_id)
"""
