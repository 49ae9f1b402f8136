"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, before_each, column_or_null, fresh, let

#: Patterns by kind, in the order in which spans are listed. They match what the plain patterns match, leftmost and
#: greedy; possessive repeats keep the matcher from recursing, and a local part is tried from its start alone.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Long texts are searched in pieces of about so many characters, so that work grows with their length alone. A piece
#: ends where no match and no word can go on, so that both parts give what the whole gives: before or after a space
#: beside a letter, before a plus after a space, or after a character of no match; further between two spaces, and at a
#: space between short numbers (a card of at most 12 digits counts in neither) - where no phone number can go on: its run
#: doesn't reach back to a plus, or has had 16 digits already and is none.
PIECE = 8_000
NO_PHONE = rf"(?:(?<=[^0-9 ().+-][0-9 ().-]{{1,40}})|(?<={'[ ().-]{0,3}[0-9]' * 16} ))"
BETWEEN = rf" (?:(?= )|(?=[0-9]{{1,6}}[^0-9 -])(?<=[^0-9 -][0-9]{{1,6}} )){NO_PHONE}"
CUT = rf"(?s).{{{PIECE}}}.*?(?:\p{{L}}(?= )| (?=[\p{{L}}+])|{BETWEEN}|[^\p{{L}}\p{{N}}\p{{M}}._%+@() -]|\z)|.+"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: A term is a word of at least four letters, anywhere in a document that holds an entity.
TERM = r"\p{L}{4,}"
#: A term is withheld if its information about the entity reaches this share of the entity's own information content.
#: PRIOR documents that hold the entity no more often than the corpus does are added to the term's own, so that few
#: documents prove little in a small corpus.
DISCLOSURE, PRIOR = 0.8, 1.0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def spans_of(gaps: Column, matches: Column) -> Column:
    """Spans of matches, given the text between them: array<struct<start, end, match>>, in code points."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def spans(v: Column) -> Column:
        count = F.sequence(F.lit(0), F.size(v["m"]) - 1)
        starts = before_each(F.transform(count, lambda k: F.length(F.get(v["g"], k)) + F.length(F.get(v["m"], k))))
        return let(
            starts,
            lambda at: F.transform(
                count,
                lambda k: let(
                    F.get(at, k) + F.length(F.get(v["g"], k)),
                    lambda start: F.struct(start.alias("start"), (start + F.length(F.get(v["m"], k))).alias("end"), F.get(v["m"], k).alias("match")),
                ),
            ),
        )

    return let(F.struct(gaps.alias("g"), matches.alias("m")), lambda v: F.when(F.size(v["m"]) > 0, spans(v)).otherwise(none))


def pieces_of(text: Column) -> Column:
    """array<struct<at, text>>: the text in pieces, with the code points before each; none of an empty text."""
    parts = F.when(F.length(text) > PIECE, F.regexp_extract_all(text, F.lit(CUT), F.lit(0))).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))

    def placed(parts: Column) -> Column:
        return let(before_each(F.transform(parts, lambda p: F.length(p))), lambda at: F.transform(parts, lambda p, k: F.struct(F.get(at, k).alias("at"), p.alias("text"))))

    return let(parts, placed)


def matches_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a piece, in order."""
    return let(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), lambda v: spans_of(v["g"], v["m"]))


def _of_one_kind(text: Column, kind: str) -> Column:
    """struct<base, rest>: a piece's valid spans of a kind, and the piece with zeros in their place; null rest without any."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")

    def blanked(gap: Column, match: Column) -> Column:
        return F.concat(gap, F.when(match.isNotNull() & valid(kind, match), F.repeat(F.lit("0"), F.length(match))).otherwise(F.coalesce(match, F.lit(""))))

    def found(v: Column) -> Column:
        good = F.filter(spans_of(v["g"], v["m"]), lambda s: valid(kind, s["match"]))
        base = F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))
        rest = F.array_join(F.zip_with(v["g"], v["m"], blanked), "")
        some = F.exists(v["m"], lambda m: valid(kind, m))
        return F.struct(F.when(some, base).otherwise(none).alias("base"), F.when(some, rest).alias("rest"))

    pattern = PATTERNS[kind]
    matched = let(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), found)
    return F.when(text.rlike(HINTS[kind]), matched).otherwise(F.struct(none.alias("base"), F.lit(None).cast("string").alias("rest")))


def _base_of_piece(piece: Column) -> Column:
    """struct<at, text, base, rest>: a piece with its spans, by kind as listed, then start, and what remains without them.

    Spans of one kind leave the joined gaps between them; where several kinds meet in a piece, spans are cut in turn.
    """

    def whole(kinds: Column) -> Column:
        base = F.flatten(F.transform(kinds, lambda k: k["base"]))
        rests = F.filter(F.transform(kinds, lambda k: k["rest"]), lambda r: r.isNotNull())
        rest = F.when(F.size(rests) == 0, piece["text"]).when(F.size(rests) == 1, F.get(rests, F.lit(0))).otherwise(without_spans(piece["text"], base))
        return F.struct(piece["at"].alias("at"), piece["text"].alias("text"), base.alias("base"), rest.alias("rest"))

    return let(F.array(*(_of_one_kind(piece["text"], k) for k in PATTERNS)), whole)


def _placed(kind: str):
    """A piece's spans of a kind, by their place in the whole text."""
    return lambda p: F.transform(
        F.filter(p["base"], _of_kind(kind)),
        lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + p["at"]).alias("start"), (s["end"] + p["at"]).alias("end")),
    )


def without_spans(text: Column, base: Column) -> Column:
    """A piece with each character of its base spans made a zero: places stay, and no word holds any of a span."""
    return F.aggregate(
        F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.repeat(F.lit("0"), s["end"] - F.greatest(a["at"], s["start"]))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)),
    )


def occurrences(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """(row, terms) for rows (row, rest): all places of each row's terms in hits (row, term), words being lower-cased."""
    pieces = rows.join(hits.select("row").distinct(), "row", "left_semi").select("row", F.explode("rest").alias("piece"))
    words = pieces.select("row", F.col("piece.at").alias("at"), F.explode(matches_of(F.col("piece.text"), TERM)).alias("word"))
    words = words.select("row", F.lower("word.match").alias("term"), F.struct((F.col("at") + F.col("word.start")).alias("start"), (F.col("at") + F.col("word.end")).alias("end")).alias("span"))
    return words.join(hits.distinct(), ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("terms"))


def most_documents(both: Column, entity: Column, total: int) -> Column:
    """How many documents a term may be in and still reveal an entity that is in `entity` of `total`, if both meet in `both`.

    log2(p(entity | term) / p) >= DISCLOSURE * log2(1 / p) for p = entity / total and
    p(entity | term) = (both + PRIOR * p) / (term + PRIOR). An entity that is everywhere has nothing to reveal: -1.
    """
    p = entity / F.lit(float(max(1, total)))
    return F.when(p < 1, (both + PRIOR * p) / F.pow(p, F.lit(1 - DISCLOSURE)) - PRIOR + 1e-9).otherwise(-1.0)


def disclosing_terms(marked: DataFrame, words: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """(row, term): the terms of each row that reveal one of its entities, counts being of documents.

    marked: row, entities, rest (the text's pieces without its base spans). words: term, documents - over the whole corpus.

    A row's term that would reveal an entity if they met in this row alone is settled by its own count, whatever the
    number of entities. Others are counted against the entities that they could reveal if they met as often as their
    counts allow; entities that are in the same documents are counted as one.
    """
    held = marked.select("row", F.explode("entities").alias("entity"))
    alike = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    classes = held.join(alike, "entity").select("row", F.struct("n", "x", "y").alias("class"))
    by_row = classes.groupBy("row").agg(F.max(most_documents(F.lit(1), F.col("class.n"), total)).alias("sure"), F.collect_set(F.when(F.col("class.n") > 1, F.col("class"))).alias("classes"))
    by_row = scratch.save(by_row, "by_row")
    most = by_row.agg(F.max("sure"), F.max(F.array_max(F.transform("classes", lambda c: most_documents(c["n"], c["n"], total))))).first()
    cap = max((m for m in most if m is not None), default=-1.0)

    rest = F.lower(F.array_join(F.col("rest.text"), ""))
    terms = marked.select("row", F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(TERM), F.lit(0)))).alias("term"))
    rare = terms.join(words.filter(F.col("documents") <= cap), "term").join(by_row, "row")
    could = F.filter("classes", lambda c: F.col("documents") <= most_documents(F.least(c["n"], F.col("documents")), c["n"], total))
    rare = rare.select("row", "term", "documents", (F.col("documents") <= F.col("sure")).alias("settled"), could.alias("open"))
    rare = scratch.save(rare.filter(F.col("settled") | (F.size("open") > 0)), "rare")

    # a settled term counts for other rows, in which no entity is rare enough to settle it
    pairs = rare.select("row", "term", "documents", "settled", F.explode("open").alias("class"))
    met = pairs.groupBy("class", "term").agg(F.count(F.lit(1)).alias("both"), F.max("documents").alias("documents"))
    met = met.filter(F.col("documents") <= most_documents(F.least("both", "documents"), F.col("class.n"), total)).select("class", "term")
    counted = pairs.filter(~F.col("settled")).join(met, ["class", "term"]).select("row", "term")
    return rare.filter("settled").select("row", "term").unionByName(counted)


def word_documents(docs: DataFrame, text: Column) -> DataFrame:
    """How many documents hold each term, over whole texts; counts are summed before they are shuffled."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """For each document: row, id, the columns in `keep`, base and terms (arrays of spans).

    base is array<struct<kind, start, end>> of emails, ip addresses, cards and phones, each kind by itself, sorted by
    kind as listed and start. terms is array<struct<start, end>>: all places outside base of the words that reveal an
    entity of the document, by how often both occur in documents of the whole corpus, wherever in them. Counts are of
    documents, repeated ones included. Documents without base spans have no terms.

    Null text: empty, no spans. Null and repeated ids: each row gives a row. Long texts are searched whole, piece by
    piece. Empty table: no rows. Other columns are ignored, but for those in `keep`.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(column_or_null(docs, text_col, "string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column_or_null(docs, id_col, "long").alias("id"), text.alias("text"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))
    columns = ["row", "id", *(f"kept_{c}" for c in keep)]
    marked = rows.select(*columns, F.transform(pieces_of(F.col("text")), _base_of_piece).alias("pieces"))
    base = F.concat(*(F.flatten(F.transform("pieces", _placed(k))) for k in PATTERNS))
    entities = F.array_distinct(F.flatten(F.transform("pieces", lambda p: F.transform(p["base"], lambda s: F.xxhash64(F.lower(s["match"]))))))
    rest = F.transform("pieces", lambda p: F.struct(p["at"].alias("at"), p["rest"].alias("text")))
    some = F.exists("pieces", lambda p: F.size(p["base"]) > 0)
    marked = marked.select(*columns, base.alias("base"), F.when(some, entities).alias("entities"), F.when(some, rest).alias("rest"))
    marked = scratch.save(marked, "marked")

    private = marked.filter(F.size("base") > 0)
    revealing = disclosing_terms(private.select("row", "entities", "rest"), word_documents(docs, text), marked.count(), scratch)
    revealing = scratch.save(revealing, "revealing")
    scratch.drop("by_row", "rare")
    terms = occurrences(private.select("row", "rest"), revealing)
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = marked.select(*columns, "base").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", none))
    return out.select(F.col("row"), F.col("id").alias(id_col), *(F.col(f"`kept_{c}`").alias(c) for c in keep), "base", "terms")


def masked(text: Column, base: Column, terms: Column) -> Column:
    """The text with [KIND] for each base span and [TERM] for each revealing term; overlapping spans give one mark."""
    spans = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))),
        F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("TERM").alias("kind"))),
    ))

    def piece(p: Column, all_spans: Column) -> Column:
        """No span goes on from one piece to the next."""
        return F.aggregate(
            F.filter(all_spans, lambda s: (s["start"] >= p["at"]) & (s["start"] < p["at"] + F.length(p["text"]))),
            F.struct(p["at"].alias("at"), F.lit("").alias("out")),
            lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(p["text"], a["at"] - p["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))).otherwise(
                F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
            ),
            lambda a: F.concat(a["out"], F.substr(p["text"], a["at"] - p["at"] + 1)),
        )

    whole = let(F.struct(spans.alias("spans"), pieces_of(text).alias("pieces")), lambda v: F.array_join(F.transform(v["pieces"], lambda p: piece(p, v["spans"])), ""))
    return F.when(F.size(base) + F.size(terms) == 0, text).otherwise(whole)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their spans masked in the text, as masked() does; all rows and columns stay.

    Null texts stay null. Null and repeated ids: each row is masked by its own spans. Long texts are masked whole.
    Columns of any name are kept. Empty table: no rows.
    """
    others = tuple(c for c in docs.columns if c != id_col)
    row, base, terms = fresh(docs, "row", "base", "terms")
    found = personal_spans(docs, id_col, text_col, keep=others).toDF(row, id_col, *others, base, terms)
    clean = masked(F.col(f"`{text_col}`"), F.col(base), F.col(terms))
    return found.select(*(clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def joined(spans: Column, kind: Column | None = None) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", kind if kind is not None else s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans: personal_spans() as counts, a digest and text.

    A document without spans has zeros, the digest of the empty string and an empty list. Nulls, repeated rows, long
    texts and an empty table are as there; other columns are ignored.
    """
    found = personal_spans(docs, id_col, text_col)
    base, terms = joined(F.col("base")), joined(F.col("terms"), F.lit("term"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select(id_col, *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))
