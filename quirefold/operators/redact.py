"""Personal data and keywords in page texts: locate, report, mask, verify, scrub."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import search
from .scans import ordered, scan

# fixed values: patterns of identity numbers, mobile telephones and addresses
PRESETS = {
    "id": r"(?<!\d)[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)",
    "phone": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
#: The same addresses, for tests of whether there is one: it starts where a local part starts and never goes back, so a
#: text without white space costs one reading. Not for taking them out: after a match the next may start within a run.
FOUND = PRESETS | {"email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}
GROW = 1.0


def _found(text: Column, preset: str) -> Column:
    """Whether the text holds one."""
    hit = text.rlike(FOUND[preset])
    return F.contains(text, F.lit("@")) & hit if preset == "email" else hit


def squeezed(s: Column) -> Column:
    """Without white space, lower case: how residues are compared."""
    return F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", ""))


def preset_hits(pages: DataFrame, presets: tuple[str, ...] = tuple(PRESETS), text: str = "text") -> DataFrame:
    """(columns of the page, source, preset, literal): a row for each occurrence. Pages without a hit cost one test."""
    keys = [c for c in pages.columns if c != text]
    found = F.array(*(F.struct(F.lit(p).alias("preset"), F.when(_found(F.col(text), p), F.regexp_extract_all(text, F.lit(PRESETS[p]), F.lit(0))).alias("all")) for p in presets))
    rows = pages.select(*keys, F.explode(found).alias("f")).select(*keys, F.lit("preset").alias("source"), "f.preset", F.explode("f.all").alias("literal"))
    return rows


def keyword_hits(pages: DataFrame, keywords: list[str], text: str = "text", ignore_case: bool = False) -> DataFrame:
    """As preset_hits, for literal words: the list is a parameter, so its size is known."""
    keys = [c for c in pages.columns if c != text]
    hay = F.lower(F.col(text)) if ignore_case else F.col(text)
    each = [F.struct(F.lit(k).alias("literal"), ((F.length(hay) - F.length(F.replace(hay, F.lit(k.lower() if ignore_case else k), F.lit("")))) / len(k)).cast("int").alias("n")) for k in keywords]
    rows = pages.select(*keys, F.explode(F.filter(F.array(*each), lambda x: x["n"] > 0)).alias("f"))
    return rows.select(*keys, F.lit("keyword").alias("source"), F.lit(None).cast("string").alias("preset"), F.explode(F.array_repeat(F.col("f.literal"), F.col("f.n"))).alias("literal"))


#: Characters of a text that are cut to grams at a time; bytes of texts that are searched for keywords at a time.
SEGMENT = 1 << 16
#: Characters by which segments overlap, at least.
OVERLAP = 16


def _grams(text: Column, width: int) -> Column:
    """All stretches of `width` characters, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))


def keyword_table_hits(pages: DataFrame, keywords: DataFrame, text: str = "text", ignore_case: bool = False) -> DataFrame:
    """As keyword_hits, for a table (keyword) of any size; a keyword that repeats counts once, an empty or null one not.

    Texts are searched where they lie (search.py): tasks test each place of a text against two tables of bits that the
    keywords have marked, and give what passes, which is joined with the keywords as a whole. So results are those of comparing
    all with all, no text is shuffled, and work is the texts' length and the keywords that stand in them."""
    keys = [c for c in pages.columns if c != text]
    plain = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    known = keywords.select(F.col("keyword").alias("__literal"), F.encode(plain(F.col("keyword")), "utf-8").alias("__needle")).where(F.length("__needle") > 0).distinct()
    known = written(known, "keywords")
    marks = search.marks(known.select("__needle"))
    hay = F.encode(F.coalesce(plain(F.col(text)), F.lit("")), "utf-8")
    rows = search.found(pages.select(*keys, hay.alias("__hay")), "__hay", marks, SEGMENT)
    hits = rows.join(known, "__needle")
    return hits.select(*keys, F.lit("keyword").alias("source"), F.lit(None).cast("string").alias("preset"), F.explode(F.array_repeat("__literal", F.col("__n"))).alias("literal"))


def mask_hits(pages: DataFrame, hits: DataFrame, keys: list[str], text: str = "text", by: str = "") -> DataFrame:
    """The pages without the literals that were found on them, the longest first, then in order of the text."""
    found = hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct((-F.length("literal")).alias("n"), "literal"))).alias("__found"))
    found = found.select(*(F.col(k).alias(f"__{k}") for k in keys), F.transform("__found", lambda x: F.encode(x["literal"], "utf-8")).alias("__found"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    joined = pages.join(found, same, "left").select(*(F.encode(c, "utf-8").alias(c) if c == text else c for c in pages.columns), "__found")
    masked = search.without(joined, text, "__found", by.encode())
    return masked.select(*(F.decode(c, "utf-8").alias(c) if c == text else c for c in pages.columns))


def locate_report(hits: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Hits by page, and a total of each document (null page); never the text."""
    return hits.rollup(doc, page).agg(F.count(F.lit(1)).alias("hits")).where(F.col(doc).isNotNull())


def redaction_report(hits: DataFrame, pages: DataFrame, doc: str = "doc_id", text: str = "text", attachments: DataFrame | None = None) -> DataFrame:
    """Counts by preset and source, pages hit, and pages that hold next to no text, of each document; attachments (a row
    each): how many went."""
    h = hits.groupBy(doc).agg(
        *(F.count_if(F.col("preset") == p).alias(f"n_{p}") for p in PRESETS),
        F.count_if(F.col("source") == "keyword").alias("n_keyword"),
        F.count_if(F.col("source") == "rect").alias("n_rect"),
    )
    p = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.length(F.trim(F.coalesce(text, F.lit("")))) < 5).alias("image_pages"))
    counts = [c for c in h.columns if c != doc]
    out = p.join(h, doc, "left")
    if attachments is not None:
        out = out.join(attachments.groupBy(doc).agg(F.count(F.lit(1)).alias("n_attachments")), doc, "left")
        counts.append("n_attachments")
    return out.select(doc, "n_pages", "image_pages", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def outcome(pages: DataFrame, hits: DataFrame, mode: str = "keywords", doc: str = "doc_id") -> DataFrame:
    """(doc, n_hits, reason): a document in which nothing was found is an error, so that nobody takes it for redacted."""
    n = hits.groupBy(doc).agg(F.count(F.lit(1)).alias("n_hits"))
    all_ = pages.select(doc).distinct().join(n, doc, "left").select(doc, F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    return all_.withColumn("reason", F.when(F.col("n_hits") == 0, F.lit(f"no_hit_{mode}")))


def mask(text: Column, presets: tuple[str, ...] = tuple(PRESETS), keywords: tuple[str, ...] = (), by: str = "") -> Column:
    """The text without any preset or keyword."""
    out = reduce(lambda t, p: F.regexp_replace(t, PRESETS[p], by), presets, text)
    return reduce(lambda t, k: F.replace(t, F.lit(k), F.lit(by)), keywords, out)


def verify(masked: DataFrame, hits: DataFrame, presets: tuple[str, ...] = tuple(PRESETS), doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(doc, verdict, residue_pages): `ok` if no removed literal and no preset is left in the whole document's text without
    white space; else the pages where it is, or all pages (`all`) if it runs across them. Only flagged ones look at pages.
    A document fails closed: what isn't `ok` must not be given out."""
    targets = hits.select(doc, F.expr("lower(regexp_replace(literal, '(?U)\\\\s+', ''))").alias("target")).where("target <> ''").distinct()
    wanted = targets.groupBy(doc).agg(F.collect_list("target").alias("targets"))
    whole = masked.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda p: squeezed(p[text])), "").alias("all"))
    any_preset = lambda t: reduce(lambda a, b: a | b, [_found(t, p) for p in presets], F.lit(False))
    joined = whole.join(wanted, doc, "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    flagged = joined.withColumn("residue", F.exists("targets", lambda t: F.contains(F.col("all"), t)) | any_preset(F.col("all"))).select(doc, "residue", "targets")
    bad = flagged.where("residue").select(F.col(doc).alias("__d"), "targets")
    where = masked.join(bad, masked[doc] == bad["__d"]).where(F.exists("targets", lambda t: F.contains(squeezed(F.col(text)), t)) | any_preset(squeezed(F.col(text))))
    pages = where.groupBy("__d").agg(F.array_join(F.transform(F.sort_array(F.collect_set(page)), lambda p: p.cast("string")), ",").alias("pages"))
    return flagged.join(pages, flagged[doc] == pages["__d"], "left").select(doc, F.when(F.col("residue"), F.lit("residue")).otherwise(F.lit("ok")).alias("verdict"), F.when(F.col("residue"), F.coalesce("pages", F.lit("all"))).alias("residue_pages"))


#: Bits of the table of marks of anchors, and of the table of how many needles share a gram: what is broadcast holds at most
#: 2^19 words of marks, or 2^20 counts, whatever the input.
MARKS, COUNTS = 25, 20
#: Widths of grams, and the step of each: grams of a hay begin at every so many characters, and so many in a row stand for
#: a needle, which takes the widest it has room for. Short ones are looked up whole, as parts of them are in most hays.
STEPS = dict.fromkeys(range(1, 8), 1) | {8: 2, 12: 4, 16: 4}
#: Needles by length, from which on: hays that hold a short one need not be searched for longer ones.
LENGTHS = (1, 4, 6, 9)


def _every(text: Column, width: int, step: int) -> Column:
    """Stretches of `width` characters, one from each `step` characters on."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}})).{{{step}}}"), F.lit(1))


def _by_width(width: Column, of) -> Column:
    """of(w) where the width is w."""
    out = F.when(width == 1, of(1))
    for w in list(STEPS)[1:]:
        out = out.when(width == w, of(w))
    return out


def _parts(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, at, part): the text in segments, each from character `at` on, that overlap by two of the longest grams."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(SEGMENT))
    cut = F.substring(F.col(text), F.col("at"), F.lit(SEGMENT + 2 * OVERLAP))
    part = F.when(F.length(text) <= SEGMENT, F.col(text)).otherwise(cut)
    return rows.select(*keep, text, F.explode(starts).alias("at")).select(*keep, "at", part.alias("part"))


def _anchors(needles: DataFrame) -> DataFrame:
    """(key, id) of needles (g, needle, digest, id, width): keys of as many grams in a row as the step of the width, there
    where the fewest needles share them. How many share a gram is counted by slots of its hash; a slot of two grams only
    makes another place look better."""
    step = _by_width(F.col("width"), lambda w: F.lit(STEPS[w]))
    parts = lambda rows: _parts(rows, "needle", "g", "digest", "width").withColumn("room", F.length("part"))
    grams = lambda rows: parts(rows).select(
        "g", "digest", "at", "room", "width", F.posexplode(_by_width(F.col("width"), lambda w: _every(F.col("part"), w, 1))).alias("pos", "gram")
    ).withColumn("slot", F.xxhash64("g", "gram").bitwiseAND(F.lit((1 << COUNTS) - 1)))
    counts = grams(needles).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    placed = grams(needles.repartition("g", "digest")).withColumn("from", F.col("pos") - F.col("pos") % step)
    placed = placed.where(F.col("from") + step - 1 + F.col("width") <= F.col("room"))
    shared = placed.join(F.broadcast(counts), "slot").groupBy("g", "digest", "at", "from").agg(F.sum("n").alias("n"))
    best = shared.groupBy("g", "digest").agg(F.min(F.struct("n", "at", "from")).alias("best"))
    stretch = F.substring(F.col("needle"), F.col("best.at") + F.col("best.from"), F.col("width") + step - 1)
    chosen = needles.join(best, ["g", "digest"]).select("g", "id", "width", stretch.alias("stretch"))
    own = _by_width(F.col("width"), lambda w: _grams(F.col("stretch"), w))
    return chosen.select("g", "id", F.explode(own).alias("gram")).select(F.xxhash64("g", "gram").alias("key"), "id")


def _marked(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows whose key may be an anchor's, by a table of bits; others have no partner, and need not travel."""
    word = F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit((1 << MARKS) - 1)), 6)
    bit = F.col("key").bitwiseAND(F.lit(63)).cast("int")
    marks = anchors.select(word.alias("__word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("one")).groupBy("__word").agg(F.bit_or("one").alias("__bits"))
    met = rows.withColumn("__word", word).join(F.broadcast(marks), "__word")
    return met.where(F.getbit("__bits", bit) == 1).select(*rows.columns)


def containments(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """(g, hay, needle) for each hay (g, hay) that contains a needle (g, needle) of the same group, each pair once.

    A hay is known by the grams that begin at each STEPS-th of its characters, a needle by as many grams in a row: wherever
    it stands in a hay, one of these begins at such a character. What meets so is verified on the texts, so results are those
    of comparing all with all; until then 64-bit hashes stand for grams and texts, and two of one hash only share
    candidates. Grams of hays that no needle has marked are left out before any shuffle; with more than some 10^7 needles
    most are marked, and travel as two numbers each. Needles longer than any hay of the group have no grams made. One large
    group spreads over its grams. Null or empty hays and needles meet nothing."""
    longest = hays.groupBy("g").agg(F.max(F.length("hay")).alias("most"))
    n = needles.where(F.length("needle") > 0).join(longest, "g").where(F.length("needle") <= F.col("most")).drop("most")
    n = n.repartition("g", "needle").distinct()  # else a group's needles stay together, as they were joined
    width = F.lit(1)
    for w, step in STEPS.items():
        width = F.when(F.length("needle") >= w + step - 1, w).otherwise(width)
    n = n.select("g", "needle", F.unhex(F.sha2("needle", 256)).alias("digest"), F.xxhash64("g", "needle").alias("id"), width.alias("width"))
    n = written(n, "needles")
    anchors = written(_anchors(n), "anchors")
    widths = sorted(r["width"] for r in n.select("width").distinct().collect())  # as many as STEPS at most
    h = hays.where(F.length("hay") > 0).distinct().withColumn("h", F.xxhash64("g", "hay"))
    cut = [F.array_distinct(_every(F.col("part"), w, STEPS[w])) for w in widths or [1]]
    looked = _parts(h, "hay", "g", "h").select("g", "h", F.explode(F.concat(*cut)).alias("gram")).select("h", F.xxhash64("g", "gram").alias("key"))
    met = _marked(looked, anchors).join(anchors, "key").select("h", "id").distinct()
    texts = n.select(F.col("g").alias("__g"), "id", "needle")
    pairs = met.join(texts, "id").join(h, "h")
    return pairs.where((F.col("g") == F.col("__g")) & F.contains("hay", "needle")).select("g", "hay", "needle")


def _holding(texts: DataFrame, targets: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Of distinct texts (g, text): those that contain a target (g, text) of their group, in parts, and the others. Targets
    come by length, and what holds one is not searched for the next."""
    found, rest = [], texts
    for low, beyond in zip(LENGTHS, (*LENGTHS[1:], None)):
        length = F.length("text")
        needles = targets.where((length >= low) & (length < beyond) if beyond else length >= low).withColumnRenamed("text", "needle")
        hold = containments(rest.withColumnRenamed("text", "hay"), needles).select("g", F.col("hay").alias("text")).distinct()
        found.append(written(hold, "holding"))
        if not found[-1].isEmpty():
            rest = written(rest.join(found[-1], ["g", "text"], "left_anti"), "rest")
        if rest.isEmpty():
            break
    return found, rest


#: Where a document has more values than this, and more targets too, they meet by containments.
FEW = 256


def scrub(values: DataFrame, targets: DataFrame, key: str, value: str, least: int = 3, presets: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """The values without those that contain, or are contained in, a target of the same document, both without white
    space and of `least` characters or more; nor those in which a preset is found. Outlines take 3, metadata 2.

    Values and targets of a document are compared directly where either are `few` at most, so the tests are at most so
    many a row. Those of crowded documents meet by an index of grams, in both directions; a value that is known to go is not
    looked up again. Results are the same."""
    v = values.withColumn("__v", squeezed(F.col(value)))
    t = targets.select(F.col(key).alias("__k"), squeezed(F.col("target")).alias("__t")).where(F.length("__t") >= least).distinct()
    enough = F.length("__v") >= (least if least > 2 else 1)
    near = (F.col(key) == F.col("__k")) & enough & (F.contains(F.col("__v"), F.col("__t")) | F.contains(F.col("__t"), F.col("__v")))
    many = lambda rows, k: rows.groupBy(F.col(k).alias("__c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("__c")
    crowded = written(many(t, "__k").join(many(v.where(enough), key), "__c"), "crowded")
    if crowded.isEmpty():
        kept = v.join(t, near, "left_anti").drop("__v")
    else:
        in_crowd, meant = F.col(key) == F.col("__c"), F.col("__k") == F.col("__c")
        others = written(t.join(crowded, meant, "left_anti"), "others")  # its size is known then: few are broadcast
        kept = v.join(crowded, in_crowd, "left_anti").join(others, near, "left_anti").drop("__v")
        rows = v.join(crowded, in_crowd, "left_semi")
        mine = written(rows.where(enough).select(F.col(key).alias("g"), F.col("__v").alias("text")).distinct(), "mine")
        theirs = written(t.join(crowded, meant, "left_semi").select(F.col("__k").alias("g"), F.col("__t").alias("text")), "theirs")
        found, rest = _holding(mine, theirs)
        hays, needles = theirs.withColumnRenamed("text", "hay"), rest.withColumnRenamed("text", "needle")
        found.append(containments(hays, needles).select("g", F.col("needle").alias("text")))
        digest = lambda c: F.unhex(F.sha2(c, 256))
        residue = reduce(DataFrame.unionByName, found).select(F.col("g").alias("__g"), digest("text").alias("__r")).distinct()
        rows = rows.withColumn("__v", digest("__v")).join(residue, (F.col(key) == F.col("__g")) & (F.col("__v") == F.col("__r")), "left_anti")
        kept = kept.unionByName(rows.drop("__v"))
    for p in presets:
        kept = kept.where(~_found(F.coalesce(F.col(value), F.lit("")), p))
    return kept


def relevel(outline: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Levels of an outline from which entries are gone: kept ancestors + 1.

    The open levels after some entries are a strictly ascending stack; those after more entries are what the lowest of
    these leaves of it, and their own. That joins associatively (scans.scan), so one huge outline is spread over tasks.
    A stack is as deep as the outline."""

    def join(open_: Column, more: Column) -> Column:
        left = F.filter(open_, lambda level: level < F.get(more, F.lit(0)))
        return F.when(F.size(more) == 0, open_).otherwise(F.concat(left, more))

    rows = ordered(outline.select(doc, "level", F.col("pos").alias("place"), "title", "page_no"), [doc], ["place", "level", "title", "page_no"])
    found = scan(rows.withColumn("own", F.array("level")), [doc], "own", join, F.array())
    depth = F.size(F.filter("before", lambda level: level < F.col("level"))) + 1
    return found.select(doc, F.col("place").alias("pos"), depth.alias("level"), "title", "page_no")


#: Side of a cell of a page, and cells on either side of the first; what lies beyond counts to the outermost.
CELL, CELLS = 64.0, 32


def _cell(c: Column) -> Column:
    return F.greatest(F.lit(-CELLS), F.least(F.lit(CELLS), F.floor(c / CELL))).cast("int")


def _in_cells(boxes: DataFrame, x0: str, y0: str, x1: str, y1: str, cx: str, cy: str) -> DataFrame:
    """A row for each cell that a box reaches into. One whose sides are out of order reaches into none."""
    side = lambda a, b: F.when(F.col(a) <= F.col(b), F.sequence(_cell(F.col(a)), _cell(F.col(b))))
    return boxes.withColumn(cx, F.explode(side(x0, x1))).withColumn(cy, F.explode(side(y0, y1)))


#: A page of more rectangles goes by cells; with fewer, each of its spans is compared with them, and no row is made twice.
FEW_RECTS = 64


def _grown(rects: DataFrame) -> DataFrame:
    low, high = (((F.col(c) - GROW).alias(f"__{c}") for c in ("x0", "y0")), ((F.col(c) + GROW).alias(f"__{c}") for c in ("x1", "y1")))
    return rects.select(F.col("doc_id").alias("__d"), F.col("page_no").alias("__p"), F.col("rect_id").alias("__rect"), *low, *high)


def _over() -> Column:
    """A span and a grown rectangle of one page overlap, and neither has its sides out of order."""
    page = (F.col("doc_id") == F.col("__d")) & (F.col("page_no") == F.col("__p"))
    over = (F.col("x0") < F.col("__x1")) & (F.col("x1") > F.col("__x0")) & (F.col("y0") < F.col("__y1")) & (F.col("y1") > F.col("__y0"))
    return page & over & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")) & (F.col("__x0") <= F.col("__x1")) & (F.col("__y0") <= F.col("__y1"))


def _overlaps(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """Spans beside the rectangles, grown by GROW on each side, that overlap them on the same page (__rect). Both are dealt
    to cells of the page, which are keys of the join, so a page of many spans and rectangles is no product; a pair that
    shares several cells is made in the one where its overlap begins."""
    r = _in_cells(_grown(rects), "__x0", "__y0", "__x1", "__y1", "__rx", "__ry")
    s = _in_cells(spans, "x0", "y0", "x1", "y1", "__cx", "__cy")
    cell = (F.col("__cx") == F.col("__rx")) & (F.col("__cy") == F.col("__ry"))
    home = (F.col("__cx") == _cell(F.greatest("x0", "__x0"))) & (F.col("__cy") == _cell(F.greatest("y0", "__y0")))
    return s.join(r, _over() & cell & home)


def _by_pages(spans: DataFrame, rects: DataFrame, few, many) -> DataFrame:
    """few(spans, rects) of pages with FEW_RECTS rectangles at most, and many(spans, rects) of the others."""
    page = ["doc_id", "page_no"]
    crowded = written(rects.groupBy(*page).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_RECTS).select(*page), "crowded")
    if crowded.isEmpty():
        return few(spans, rects)
    of = lambda how: (spans.join(crowded, page, how).select(*spans.columns), rects.join(crowded, page, how))
    return few(*of("left_anti")).unionByName(many(*of("left_semi")))


def rect_hits(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """(columns of the span, rect_id): spans that a rectangle of the same page, grown by GROW on each side, overlaps."""
    hit = lambda met: met.select(*spans.columns, F.col("__rect").alias("rect_id"))
    return _by_pages(spans, rects, lambda s, r: hit(s.join(_grown(r), _over())), lambda s, r: hit(_overlaps(s, r)))


def mask_by_rect(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """The spans (or annotations, or fields) that no grown rectangle overlaps: spans of one place go or stay together."""
    place = ["doc_id", "page_no", "x0", "y0", "x1", "y1"]

    def many(s: DataFrame, r: DataFrame) -> DataFrame:
        hit = _overlaps(s.select(*place).distinct(), r).select(*place).distinct()
        return s.join(hit, place, "left_anti").select(*spans.columns)

    return _by_pages(spans, rects, lambda s, r: s.join(_grown(r), _over(), "left_anti"), many)


def rect_rules(rects: DataFrame) -> DataFrame:
    """Adds reason: what is wrong with a rectangle's numbers, null if nothing."""
    odd = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in ("x", "y", "w", "h")])
    return rects.withColumn("reason", F.when(odd, "not_finite").when(F.coalesce(F.col("page") < 1, F.lit(True)), "page").when((F.col("w") <= 0) | (F.col("h") <= 0), "size").when((F.col("x") < 0) | (F.col("y") < 0), "origin"))


def keyword_rules(specs: DataFrame, most: int = 100) -> DataFrame:
    """spec: JSON text {presets:[], custom:[]}. Adds presets, custom (trimmed, blanks gone) and reason, null if it holds."""
    spec = F.from_json("spec", "presets array<string>, custom array<string>")
    none = F.array().cast("array<string>")
    rows = specs.withColumn("__s", spec).withColumn("presets", F.coalesce("__s.presets", none))
    rows = rows.withColumn("custom", F.filter(F.transform(F.coalesce("__s.custom", none), lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")).drop("__s")
    unknown = F.size(F.array_except("presets", F.array(*map(F.lit, PRESETS)))) > 0
    long = F.exists("custom", lambda c: F.length(c) > most)
    return rows.withColumn("reason", F.when(unknown, "unknown_preset").when(long, "too_long").when((F.size("presets") == 0) & (F.size("custom") == 0), "empty"))
