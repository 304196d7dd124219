"""The archive's desk: filters, scopes, views, provenance, aliases, titles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settled import settle
from .skew import lookup

SORTS = ("relevance", "uploaded", "-uploaded", "date", "-date")
STATUSES = ("new", "todo", "done")


@dataclass(frozen=True)
class Filters:
    """Arguments of a document list; a value outside its limits is refused.

    Documents have (doc_id, folder, kind, sender, series, status, important,
    read_at, uploaded_at, day, deleted_at); `tags` are (doc_id, tag).
    """

    ids: Sequence = ()
    folders: Sequence = ()
    unfiled: bool = False
    kinds: Sequence = ()
    senders: Sequence = ()
    tags: Sequence = ()
    series: object = None
    status: Sequence[str] = ()
    important: bool | None = None
    unread: bool | None = None
    uploaded_from: date | None = None
    uploaded_to: date | None = None
    date_from: date | None = None
    date_to: date | None = None
    sort: str = "-uploaded"
    page: int = 1
    page_size: int = 25

    def __post_init__(self):
        if len(self.ids) > 100:
            raise ValueError("at most 100 ids")
        if self.page < 1 or not 1 <= self.page_size <= 100:
            raise ValueError("pages start at 1 and have 1 to 100 rows")
        if self.sort not in SORTS or not set(self.status) <= set(STATUSES):
            raise ValueError("unknown sort or status")

    def predicate(self) -> Column:
        """All filters but the tags, without deleted documents."""
        out = F.col("deleted_at").isNull()
        for name, some in (("doc_id", self.ids), ("kind", self.kinds), ("sender", self.senders), ("status", self.status)):
            out = out & F.col(name).isin(list(some)) if some else out
        placed = F.col("folder").isin(list(self.folders)) if self.folders else None
        if self.unfiled:
            placed = F.col("folder").isNull() if placed is None else placed | F.col("folder").isNull()
        out = out if placed is None else out & placed
        out = out if self.series is None else out & (F.col("series") == self.series)
        out = out if self.important is None else out & (F.col("important") == self.important)
        out = out if self.unread is None else out & (F.col("read_at").isNull() == self.unread)
        for name, low, high in (("uploaded_at", self.uploaded_from, self.uploaded_to), ("day", self.date_from, self.date_to)):
            out = out if low is None else out & (F.to_date(name) >= F.lit(low))
            out = out if high is None else out & (F.to_date(name) <= F.lit(high))
        return out

    def rows(self, docs: DataFrame, tags: DataFrame) -> DataFrame:
        """The documents; of several tags every one must be there."""
        out = docs.filter(self.predicate())
        for tag in self.tags:
            out = out.join(tags.filter(F.col("tag") == tag).select("doc_id"), "doc_id", "left_semi")
        return out

    def order(self) -> list[Column]:
        """Rows without a date come last in either direction; ids decide ties."""
        name = "day" if self.sort.endswith("date") else "uploaded_at"
        down = self.sort.startswith("-") or self.sort == "relevance"
        first = F.desc_nulls_last(name) if down else F.asc_nulls_last(name)
        return [first, F.desc("doc_id") if down else F.asc("doc_id")]

    def listed(self, docs: DataFrame, tags: DataFrame) -> DataFrame:
        """(place, total, columns of docs, tags): one page, in order, with the
        tags of its rows sorted without regard to case."""
        rows = self.rows(docs, tags)
        total = rows.agg(F.count("*").alias("total"))
        start = (self.page - 1) * self.page_size
        shown = rows.orderBy(*self.order()).offset(start).limit(self.page_size)
        sorted_tags = F.transform(F.array_sort(F.collect_set(F.struct(F.lower("tag").alias("low"), F.col("tag").alias("tag")))), lambda t: t["tag"])
        named = tags.join(F.broadcast(shown.select("doc_id")), "doc_id").groupBy("doc_id").agg(sorted_tags.alias("tags"))  # a page
        place = F.row_number().over(Window.orderBy(*self.order())) + start  # of one page's rows
        return shown.join(F.broadcast(named), "doc_id", "left").crossJoin(F.broadcast(total)).withColumn("place", place)


def scope(docs: DataFrame, closure: DataFrame | None, folder=None, excluded: Sequence = (), ids: Sequence | None = None) -> DataFrame:
    """A selection, a folder (with those below it if `closure`, pairs (folder,
    up), is given) without the excluded documents, or all; not deleted."""
    if ids is not None and folder is not None:
        raise ValueError("a selection or a folder, not both")
    out = docs.filter("deleted_at IS NULL")
    if ids is not None:
        return out.filter(F.col("doc_id").isin(list(ids)))
    if folder is not None:
        inside = closure.filter(F.col("up") == folder).select("folder") if closure is not None else None
        out = out.join(inside, "folder", "left_semi") if inside is not None else out.filter(F.col("folder") == folder)
    return out.filter(~F.col("doc_id").isin(list(excluded))) if excluded else out


def visible_pages(pages: Column, count: Column, order: Column, blank: Column) -> Column:
    """The stored order, cut to pages that exist; else all pages but the blank
    ones, or all where every page is blank."""
    every = F.sequence(F.lit(1), count)
    rest = F.array_except(every, blank)
    return F.when(order.isNotNull(), F.filter(order, lambda n: n.between(1, count))).when(F.size(rest) > 0, rest).otherwise(every)


def blank_pages(pages: Column, ink: float = 0.0001) -> Column:
    """Numbers of the pages of (number, ink, chars) that have neither ink nor text."""
    return F.array_sort(F.transform(F.filter(pages, lambda p: (p["ink"] < ink) & (p["chars"] == 0)), lambda p: p["number"]))


def patched(sources: Column, patch: Column) -> Column:
    """The fields of the map `patch` that may be written: those whose source in
    the map `sources` is `auto` or not recorded."""
    return F.map_filter(patch, lambda name, _: F.coalesce(sources[name], F.lit("auto")) == "auto")


def user_edited(sources: Column) -> Column:
    return F.exists(F.map_entries(sources), lambda e: (e["value"] == "user") & (e["key"] != "tags_removed"))


def merge_senders(senders: DataFrame, docs: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(senders, docs) after merging: documents point to the target, whose
    aliases are united with the names and aliases of the sources.

    senders: (sender, name, aliases); merges: (sender, target), a sender once and
    no target a source.
    """
    moved = senders.join(merges, "sender")
    spelled = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append("aliases", F.col("name"))))))
    taken = moved.groupBy(F.col("target").alias("sender")).agg(spelled.alias("taken"))
    kept = senders.join(merges.select("sender"), "sender", "left_anti").join(taken, "sender", "left")
    united = F.array_sort(F.array_union("aliases", F.coalesce("taken", F.array().cast("array<string>"))))
    after = kept.select("sender", "name", F.array_remove(united, F.col("name")).alias("aliases"))
    return after, docs.join(merges, "sender", "left").withColumn("sender", F.coalesce("target", "sender")).drop("target")


def learned_aliases(senders: DataFrame, read: DataFrame, most: int = 30) -> DataFrame:
    """(sender, aliases): what was read on documents (sender, spelling) joins the
    sender's aliases, sorted, at most `most`, unless another sender that has
    documents owns the spelling, as its name or alias. Case does not matter."""
    low = lambda c: F.lower(F.col(c))
    having = senders.join(read.select("sender").distinct(), "sender", "left_semi")
    owned = having.select(F.col("sender").alias("owner"), F.explode(F.array_append("aliases", F.col("name"))).alias("own"))
    # another sender owns a spelling if its smallest or its largest owner is another: no reader meets all owners
    owned = settle(owned.groupBy(low("own").alias("low")).agg(F.min("owner").alias("least"), F.max("owner").alias("most")))
    new = read.select("sender", "spelling", low("spelling").alias("low")).distinct()
    new = settle(new)
    others = lookup(new, owned, "low").filter("least <> sender OR most <> sender").select("sender", "low")
    free = new.join(others, ["sender", "low"], "left_anti").groupBy("sender").agg(F.collect_set("spelling").alias("more"))
    united = F.slice(F.array_sort(F.array_remove(F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>"))), F.col("name"))), 1, most)
    return senders.join(free, "sender", "left").select("sender", united.alias("aliases"))


#: Words that alone, or with numbers, make a title that says nothing.
GENERIC = (
    "scan", "scanned", "dokument", "document", "img", "image", "bild", "datei", "file", "unbenannt", "untitled", "neu", "new", "seite", "page", "brief", "letter",
)
# Words that a name leaves behind at either end of a title.
LEFT_BEHIND = ("von", "vom", "der", "des", "from")


def generic_title(title: Column) -> Column:
    return title.rlike(rf"(?i)^\s*({'|'.join(GENERIC)}|[0-9][0-9\s._-]*)\b[\s0-9._-]*$")


def without_sender(title: Column, *senders: Column) -> Column:
    """The title without the names of senders (3 letters or more) and what is
    left over of separators; the title itself if less than 6 letters stay."""
    out = title
    for name in senders:
        named = F.regexp_replace(out, F.concat(F.lit(r"(?i)\Q"), name, F.lit(r"\E")), F.lit(""))
        out = F.when(F.length(name) >= 3, named).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"^[ \-–—:,|/]+|[ \-–—:,|/]+$", "")
    behind = "|".join(LEFT_BEHIND)
    out = F.regexp_replace(F.regexp_replace(out, rf"(?i)^({behind})\s+", ""), rf"(?i)\s+({behind})$", "")
    return F.when(F.length(out) >= 6, out).otherwise(title)


def plural(name: Column) -> Column:
    return F.when(name.endswith("s"), name).when(name.endswith("y"), F.concat(F.substr(name, F.lit(1), F.length(name) - 1), F.lit("ies"))).otherwise(F.concat(name, F.lit("s")))


def series_name(sender: Column, kind: Column) -> Column:
    """`Sender – Kinds`; either may be missing, `other` and `mail` are no kinds."""
    name = F.concat_ws(" – ", sender, F.when(~F.lower(kind).isin("other", "mail"), plural(kind)))
    return F.when(name != "", name).otherwise("Recurring documents")


# Names of months in titles, English and German.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    "Januar", "Februar", "März", "Mai", "Juni", "Juli", "Oktober", "Dezember",
)
#: A month or quarter with its year, a day or month in figures, or a year alone.
PERIOD = "(" + "|".join((rf"(?:{'|'.join(MONTH_NAMES)})\s+[0-9]{{4}}", r"Q[1-4]\s+[0-9]{4}", "[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?", r"\b(?:19|20)[0-9]{2}\b")) + ")"


def learned_titles(docs: DataFrame, newest: int = 10) -> DataFrame:
    """(doc_id, learned): the title of the latest of the `newest` siblings of a
    series that a user named, with the document's own period in place of its.

    docs: (doc_id, series, uploaded_at, title, by_user, period). Each series is
    reduced to its `newest` + 1 rows before it meets its documents.
    """
    order = Window.partitionBy("series").orderBy(F.desc("uploaded_at"), F.desc("doc_id"))
    top = docs.filter("series IS NOT NULL").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= newest + 1)
    kept = top.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("n", "doc_id", "title", "by_user", "period"))).alias("siblings"))
    rows = docs.filter("series IS NOT NULL AND period IS NOT NULL").join(kept, "series")
    others = F.slice(F.filter("siblings", lambda s: s["doc_id"] != F.col("doc_id")), 1, newest)
    put = F.regexp_replace  # the first period alone

    def titled(s: Column) -> Column:
        mine = F.col("period")
        swapped = F.replace(s["title"], s["period"], mine)
        first = put(s["title"], F.lit("^(.*?)" + PERIOD), F.concat(F.lit("$1"), mine))
        return F.when(F.coalesce(s["title"].contains(s["period"]), F.lit(False)), swapped).when(s["title"].rlike(PERIOD), first)

    usable = F.filter(F.transform(F.filter(others, lambda s: s["by_user"]), titled), lambda t: t.isNotNull())
    return rows.select("doc_id", F.get(usable, F.lit(0)).alias("learned"))


def generated_title(learned: Column, subject: Column, sender: Column, kind: Column, period: Column) -> Column:
    """The learned title; a subject of 6 letters or more, with the sender unless
    it is named; kind, sender and period; or `Untitled document`. 200 at most."""
    named = F.when(sender.isNull() | F.lower(subject).contains(F.lower(sender)), subject).otherwise(F.concat(subject, F.lit(" – "), sender))
    parts = F.concat_ws(" ", F.when(F.lower(kind) != "other", kind), sender, period)
    title = F.coalesce(learned, F.when(F.length(subject) >= 6, named), F.when(parts != "", parts), F.lit("Untitled document"))
    return F.substring(title, 1, 200)


def top_words(rows: DataFrame, group: str, item: str, word: str) -> DataFrame:
    """(group, word, n): words in at least half of a group's items, rounded up."""
    distinct = rows.select(group, item, word).distinct()
    sizes = rows.groupBy(group).agg(F.count_distinct(item).alias("items"))
    counts = distinct.filter(F.col(word).isNotNull()).groupBy(group, word).agg(F.count("*").alias("n")).join(sizes, group)
    return counts.filter(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("items") / 2))).select(group, word, "n")


def grouped_for_filing(docs: DataFrame, big: int = 2) -> DataFrame:
    """(doc_id, group): documents that belong together, the strongest sign first.

    docs: (doc_id, series, sender, kind, head), head the first word of a title.
    A series is a group. Of the rest, those of a sender and kind, or of a sender
    without kind, are split by heads where two heads or more have `big` documents,
    the others staying together; those without a sender go by head; those
    without any stay alone.
    """
    loose = F.col("series").isNull()
    pair = F.when(F.col("sender").isNotNull(), F.concat_ws("|", F.lit("p"), "sender", F.coalesce(F.col("kind").cast("string"), F.lit(""))))
    rows = docs.withColumn("base", F.when(loose, pair))
    sized = rows.filter("base IS NOT NULL AND head IS NOT NULL").groupBy("base", "head").agg(F.count("*").alias("n")).filter(F.col("n") >= big)
    several = sized.groupBy("base").agg(F.count("*").alias("heads")).filter("heads >= 2")
    joined = rows.join(sized.join(several, "base").select("base", "head", F.lit(True).alias("apart")), ["base", "head"], "left")
    split = F.coalesce("apart", F.lit(False))
    group = (
        F.when(~loose, F.concat(F.lit("s|"), "series"))
        .when(F.col("base").isNotNull(), F.when(split, F.concat_ws("|", "base", "head")).otherwise(F.concat("base", F.lit("|"))))
        .when(F.col("head").isNotNull(), F.concat(F.lit("h|"), "head"))
        .otherwise(F.concat(F.lit("d|"), "doc_id"))
    )
    return joined.select("doc_id", group.alias("group"))
