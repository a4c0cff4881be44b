"""Secret scans with multipart credential linking, with DataFrame functions only.

Three base kinds are always reported: assign (a named secret with a value of 8 or more characters), access (AKIA and
at least 12 more) and hex (32 or more). Three weak kinds are candidates only: ident (a named user, client or key id),
blob (a bare token of 40 or more base64 characters with digit, lower and upper case) and endpoint (a URL with a
scheme). A named id may have a prefix that ends in a character other than a letter or digit (aws_access_key_id).
Within a document, an interval join pairs spans with at most SCOPE characters between the end of one and the start of
the other, and a weak candidate is reported only next to what completes it: an ident next to a secret (assign, hex or
blob), a blob next to an identifier (access or ident), an endpoint next to both.

Spans are in code points. They are read off the text by marking every match with two characters, splitting there, and
summing lengths in two levels, so that a text with many matches costs no square of them. The interval join is an
equi-join on (row, block of SCOPE characters) over all blocks that a span lies in, so a span meets at most what fits
into its own blocks and one or two on either side. A pair that meets in several blocks counts once, as links are flags.

Edge cases: null text counts as empty; repeated rows and null ids each keep a row of their own; a text's own private-
use marks are replaced by another character before matching (same length, part of no pattern); an empty table gives an
empty table; texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, let

SCOPE = 256
LEFT, RIGHT, OTHER = "\ue000", "\ue001", "\ue002"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, test of the matched text. A run of one class matches whole, so its least length can stand in the pattern.
BASE = (
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    ("access", r"AKIA[A-Z0-9]{12,}+", None),
    ("hex", r"[0-9a-f]{32,}+", None),
)
WEAK = (
    ("ident", r"""(?i)(?<![A-Za-z0-9])(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+""", None),
    ("blob", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}", lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
    ("endpoint", r"""(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}""", None),
)
KINDS = [k for k, *_ in (*BASE, *WEAK)]
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "id", "ident": "id", "endpoint": "endpoint"}
STEP = 256


def spans(text: Column, kind: int, pattern: str, test) -> Column:
    """array<struct<start,kind,end>> of the leftmost non-overlapping matches of one pattern that pass its test."""
    marked = F.regexp_replace(text, pattern, f"{LEFT}$0{RIGHT}")

    def from_pieces(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(F.replace(p, F.lit(RIGHT), F.lit(""))))

        def from_lengths(n: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / STEP).cast("int"))
            total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
            sums = F.transform(blocks, lambda b: total(F.slice(n, b * STEP + 1, STEP)))

            def from_sums(s: Column) -> Column:
                before = F.transform(blocks, lambda b: total(F.slice(s, F.lit(1), b)))

                def from_before(first: Column) -> Column:
                    def one(i: Column) -> Column:
                        b = F.floor(i / STEP).cast("int")
                        start = F.get(first, b) + total(F.slice(n, b * STEP + 1, i - b * STEP))
                        match = F.substring_index(F.get(pieces, i), RIGHT, 1)
                        return F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), (start + F.length(match)).cast("long").alias("end"), (test(match) if test else F.lit(True)).alias("ok"))

                    return F.transform(F.sequence(F.lit(1), F.size(n) - 1), one)

                return let(before, from_before)

            return let(sums, from_sums)

        found = F.when(F.size(pieces) > 1, let(lengths, from_lengths))
        return F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return F.coalesce(let(F.split(marked, LEFT, -1), from_pieces), none)


def scan(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, base and weak span arrays for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.when(text.contains(LEFT) | text.contains(RIGHT), F.translate(text, LEFT + RIGHT, OTHER + OTHER)).otherwise(text)
    found = lambda kinds, first: F.concat(*[spans(F.col("_text"), first + k, p, t) for k, (_, p, t) in enumerate(kinds)])
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), clean.alias("_text"))
    return rows.select("_rid", "doc_id", found(BASE, 0).alias("base"), found(WEAK, len(BASE)).alias("weak"))


def link(scanned: DataFrame) -> DataFrame:
    """_rid and the weak spans that a complementary part completes, from the table that ``scan`` gives."""
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("s.kind") + 1)
    both = scanned.where(F.size("weak") > 0).where(F.size("base") + F.size("weak") > 1)
    parts = both.select("_rid", F.explode(F.concat("base", "weak")).alias("s")).select("_rid", "s", role.alias("role"))
    blocks = lambda start, end: F.explode(F.sequence(F.floor(start / SCOPE), F.floor(end / SCOPE))).alias("block")
    seek = parts.where(F.col("s.kind") >= len(BASE)).select("_rid", F.col("s").alias("w"), F.col("role").alias("own"), blocks(F.col("s.start") - SCOPE, F.col("s.end") + SCOPE))
    place = parts.select("_rid", "s", "role", blocks(F.col("s.start"), F.col("s.end")))
    gap = F.greatest(F.col("w.start") - F.col("s.end"), F.col("s.start") - F.col("w.end"))
    meet = seek.join(place, ["_rid", "block"]).where((F.col("own") != F.col("role")) & (gap <= SCOPE))
    has = meet.groupBy("_rid", "w", "own").agg(F.bool_or(F.col("role") == "id").alias("id"), F.bool_or(F.col("role") == "secret").alias("secret"))
    full = F.when(F.col("own") == "endpoint", F.col("id") & F.col("secret")).when(F.col("own") == "id", F.col("secret")).otherwise(F.col("id"))
    return has.where(full).groupBy("_rid").agg(F.collect_list("w").alias("linked"))


def _text(found: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, kind number, end), linked (likewise, or null) for every row."""
    scanned = checkpointed(scan(docs))
    linked = link(scanned)
    sure = scanned.where(F.size("weak") == 0).select("doc_id", "base", F.lit(None).cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("linked"))
    return sure.unionByName(scanned.where(F.size("weak") > 0).join(linked, "_rid", "left").select("doc_id", "base", "linked"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from what ``find_secrets`` gives."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.concat("base", F.coalesce("linked", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(every).alias("spans")
    )
