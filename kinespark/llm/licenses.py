"""Canonical digest lookup of licences: whole texts against the digests of known licence texts.

Both sides are brought to one form: lower case, no lines that state a copyright, letters and digits with single spaces,
words of equivalent spellings as one. The sha256 of the form is joined with the digests of the known texts. Only DataFrame
functions are used. Known texts are a table (license, text) of any size, or a mapping; their digests are broadcast after
their number is checked, else joined by shuffle.

Defined results: null and empty texts, and texts of copyright lines alone, have the digest of the empty form and match no
licence; each row is looked up, repeated or not; of known texts with one form, the first name is reported.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm.license_texts import LICENSES

#: Spellings taken as the same word. Fixed values.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: Spellings of two words, after the above. Fixed values.
PAIRS = (("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"))
#: A line that states a copyright: comment marks, then the word or sign, then a year, a name or nothing.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(?:copyright(?: \(c\)| ©)?|\(c\)|©) [^\n]*$|^[ \t#*/;-]*all rights reserved\.?[ \t]*$"
#: Texts of known licences up to this many rows are broadcast.
BROADCAST_ROWS = 20_000


def any_spelling() -> str:
    """A pattern that finds one of the spellings as a whole word; words of one first letter share a branch."""
    words = sorted({one for one, _ in SPELLINGS} | {one for one, _ in PAIRS})
    branches = (f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in sorted({w[0] for w in words}))
    return f"(?:^| )(?:{'|'.join(branches)})(?: |$)"


def canonical(text: Column) -> Column:
    form = F.lower(F.coalesce(text, F.lit("")))
    stated = F.contains(form, F.lit("copyright")) | F.contains(form, F.lit("(c)")) | F.contains(form, F.lit("©")) | F.contains(form, F.lit("all rights reserved"))
    form = F.when(stated, F.regexp_replace(form, COPYRIGHT_LINE, "")).otherwise(form)
    form = F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "))
    # each word between spaces of its own, so that neighbours are both replaced
    spelled = F.concat(F.lit(" "), F.replace(form, F.lit(" "), F.lit("  ")), F.lit(" "))
    for one, other in (*SPELLINGS, *PAIRS):
        spelled = F.replace(spelled, F.lit(f" {one} ".replace(" ", "  ")[1:-1]), F.lit(f" {other} ".replace(" ", "  ")[1:-1]))
    return F.when(F.rlike(form, F.lit(any_spelling())), F.trim(F.replace(spelled, F.lit("  "), F.lit(" ")))).otherwise(form)


def known_digests(spark: SparkSession, licenses: Mapping[str, str] | DataFrame = LICENSES) -> DataFrame:
    texts = licenses if isinstance(licenses, DataFrame) else spark.createDataFrame(sorted(licenses.items()), "license string, text string")
    digests = texts.select("license", canonical(F.col("text")).alias("form")).filter("form <> ''")
    return digests.groupBy(F.sha2(F.encode("form", "utf-8"), 256).alias("__known")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: Mapping[str, str] | DataFrame = LICENSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license) of every whole text; license is null where none is known."""
    known = known_digests(docs.sparkSession, licenses)
    n = licenses.count() if isinstance(licenses, DataFrame) else len(licenses)
    known = F.broadcast(known) if n <= BROADCAST_ROWS else known
    marked = docs.select(docs[id_col].alias(id_col), F.sha2(F.encode(canonical(docs[text_col].cast("string")), "utf-8"), 256).alias("digest"))
    return marked.join(known, F.col("digest") == F.col("__known"), "left").select(id_col, "digest", "license")


def oracle(licenses: Mapping[str, str] = LICENSES) -> str:
    """The same by lists of words and a table of spellings."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    spelling = f"MAP {{{', '.join(f'{quote(a)}: {quote(b)}' for a, b in SPELLINGS)}}}"

    def form(text: str) -> str:
        lines = f"list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda line: NOT regexp_matches(line, {quote(COPYRIGHT_LINE.removeprefix('(?m)'))}))"
        words = rf"string_split(trim(regexp_replace(array_to_string({lines}, chr(10)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
        made = f"array_to_string(list_transform({words}, lambda w: coalesce({spelling}[w], w)), '  ')"
        made = f"' ' || {made} || ' '"
        for one, other in PAIRS:
            made = f"replace({made}, {quote(' ' + one.replace(' ', '  ') + ' ')}, {quote(' ' + other.replace(' ', '  ') + ' ')})"
        return f"trim(replace({made}, '  ', ' '))"

    quoted = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(licenses.items()))
    return f"""
WITH known AS (SELECT sha256(form) AS digest, min(license) AS license FROM (SELECT license, {form('text')} AS form FROM (VALUES {quoted}) v(license, text)) WHERE form <> '' GROUP BY 1),
marked AS (SELECT doc_id, sha256({form('text')}) AS digest FROM documents)
SELECT doc_id, marked.digest, license FROM marked LEFT JOIN known ON marked.digest = known.digest"""
