"""Operator 7: secret scans with corpus-wide ownership.

Candidates are found in each text; hashes of their values are counted over the corpus by
distinct documents (repositories) and sources (owners). A value that many owners or very many
repositories hold is a copied example. One that few hold is live if it also looks so: no
placeholder, no identifier, and, for bare hexadecimal digits, named as a secret beside it."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import basic, packed, prepare, staged, texts_of, unpacked

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
#: A value that at least so many sources hold is an example; where there are fewer sources, one that all of them hold, if they are two or more.
EXAMPLE_OWNERS = 5
#: So is one that at least so many repositories hold, whoever owns them. High, as a live secret that is taken for an example stays in the text.
EXAMPLE_REPOSITORIES = 1000
#: Bits a character that an opaque candidate has at least.
ENTROPY = 3.5
#: Bits a character that a base value has at least to look live.
BASE_ENTROPY = 2.5
#: Spans of one value beyond which its counts are broadcast, one line for every so many spans at most.
HOT_VALUE = 1 << 16
_PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|change.?me|your[_-]|insert|redacted|xxxx|\*\*\*|(.)\1{7}", re.I)
_IDENTIFIER = re.compile(r"[A-Za-z]+(?:[._-]+[A-Za-z]+)+[._-]*")
_SECRET_NAME = re.compile(r"""(?:key|secret|token|passwo?r?d|pwd|auth\w*|credentials?|signature|bearer)["'\])]{0,2}\s{0,2}(?:=>|[:=]|is)?\s{0,2}["'(]{0,2}$""", re.I)
_SPANS = "array<struct<start:int,kind:int,end:int,value:string,looks:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the base kinds, by start, then kind."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _bits(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def opaque_spans(text: str, base: list[tuple]) -> list[tuple[int, int, int, str]]:
    """Further candidates: long mixed strings of high entropy that no base span overlaps."""
    if max(map(len, text.split()), default=0) < 24:
        return []
    out = []
    for m in OPAQUE.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and _bits(s) >= ENTROPY:
            if not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                out.append((m.start(), 3, m.end(), s))
    return out


def looks_live(kind: int, value: str, before: str = "", assigned: bool = False) -> bool:
    """Whether a value looks like a credential in use, by itself and the characters before it.

    Hexadecimal digits alone are mostly hashes and ids: they count where an assignment holds them, or the
    name of a secret stands right before them."""
    if _PLACEHOLDER.search(value) or _bits(value) < BASE_ENTROPY:
        return False
    if kind == 0:
        return not _IDENTIFIER.fullmatch(value)
    return kind != 2 or assigned or _SECRET_NAME.search(before[-40:]) is not None


def found_in(text: str) -> list[tuple[int, int, int, str, bool]]:
    """All candidates of a text: (start, number of the kind, end, value, whether it looks live), base spans first."""
    base = base_spans(text)
    assigned = [(a, b) for a, k, b, _ in base if k == 0]
    out = [(a, k, b, v, looks_live(k, v, text[max(0, a - 40) : a], k == 2 and any(x <= a and b <= y for x, y in assigned))) for a, k, b, v in base]
    return out + [(a, k, b, v, looks_live(k, v)) for a, k, b, v in opaque_spans(text, base)]


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `spans`, all candidates of the whole text, values as hashes, and `content`, the text's hash."""
    names = docs.columns
    text_at = names.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("looks", pa.bool_())]))
        for batch in batches:
            spans, content = [], []
            for text in texts_of(batch.column(text_at)):
                spans.append([{"start": a, "kind": k, "end": b, "value": xxhash.xxh3_128_hexdigest(v), "looks": x} for a, k, b, v, x in found_in(text)])
                content.append(xxhash.xxh3_64_intdigest(text) - (1 << 63) if spans[-1] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind), pa.array(content, pa.int64())], [*names, "spans", "content"])

    prepare(docs.sparkSession)
    out = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"spans {_SPANS}, content long").fields])
    return docs.mapInArrow(scan, out)


def ownership(found: DataFrame) -> DataFrame:
    """Per value: n_repositories (an owner's distinct texts, over all owners), n_owners (distinct sources) that hold it, and n_spans.

    Equal (value, owner, text) rows are merged before the shuffle, then the texts of an owner, then
    the owners, so a value that a third of all rows hold is a handful of rows when it is shuffled."""
    each = found.select("source", "content", F.explode("spans.value").alias("value")).groupBy("value", "source", "content").agg(F.count("*").alias("n"))
    owned = each.groupBy("value", "source").agg(F.count("*").alias("n"), F.sum("n").alias("spans"))
    return owned.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("spans").alias("n_spans"))


def decided(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per row with candidates, by `row`: its spans with `example`, whether many owners or very many repositories hold
    the value, `live`, whether it is no example and looks live, and both counts."""
    owners_all = found.select("source").distinct().count()
    enough = min(example_owners, max(2, owners_all))
    hit = found.filter(F.size("spans") > 0)
    owners = staged(ownership(hit), "secret-owners").withColumn("example", (F.col("n_owners") >= enough) | (F.col("n_repositories") >= example_repositories))
    each = hit.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    # The values of very many spans are few, by their number: they go to the spans, whose rows stay where they are.
    common = each.join(F.broadcast(owners.filter(F.col("n_spans") > HOT_VALUE)), "value", "left")
    rest = common.filter("n_spans is null").select(*each.columns).join(owners.filter(F.col("n_spans") <= HOT_VALUE), "value")
    each = common.filter("n_spans is not null").unionByName(rest).withColumn("live", ~F.col("example") & F.col("looks"))
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "example", "n_repositories", "n_owners"))).alias("spans"))


def _joined(spans):
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_added, and the
    counts of repositories and owners that hold the value of each of `spans`, in their order.

    Base spans stay whatever their ownership; opaque candidates are added, as kind `live`, where they
    look live. A null text is empty; a null source is an owner of its own; repeated rows count
    as one repository. An empty table gives no rows; other columns are ignored."""
    found = candidates(basic(docs, "doc_id", "source", "text")).drop("text").withColumn("row", F.monotonically_increasing_id())
    found = staged(found, "secret-candidates")
    known = decided(found, example_owners, example_repositories).withColumnRenamed("spans", "known")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    rows = found.join(known, "row", "left")
    kept = F.coalesce(F.filter("known", lambda s: (s["kind"] < 3) | s["live"]), F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,example:boolean,n_repositories:bigint,n_owners:bigint>>"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    held = lambda n: F.array_join(F.transform(kept, lambda s: s[n].cast("string")), ",")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(kept).alias("spans"),
        F.size(F.filter(kept, lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter(kept, lambda s: s["example"])).cast("long").alias("n_example"), F.size(F.filter(kept, lambda s: s["kind"] == 3)).cast("long").alias("n_added"),
        held("n_repositories").alias("repositories"), held("n_owners").alias("owners"),
    )


def redacted(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, mark: str = "[SECRET]", example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """docs with every live secret of the text replaced by `mark`; examples, and what doesn't look live, stay.

    Overlapping spans are replaced as one. n_chars, where there is one, follows the text. All rows stay, repeated
    ones as often as they come; a null or empty text stays as it is, and so does an empty table."""
    columns, schema = docs.columns, docs.schema
    kept = ("text", "source", "n_chars") if "n_chars" in columns else ("text", "source")
    docs = packed(docs, *kept)
    names = docs.columns
    found = staged(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    live = decided(found, example_owners, example_repositories).select("row", F.filter("spans", lambda s: s["live"]).alias("cuts")).filter(F.size("cuts") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, cuts = [], batch.column(len(names)).to_pylist()
            for text, spans in zip(texts_of(batch.column(at)), cuts):
                parts, done = [], 0
                for s in spans:
                    if s["start"] >= done:
                        parts += (text[done : s["start"]], mark)
                    done = max(done, s["end"])
                texts.append("".join(parts) + text[done:])
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    changed = found.filter(F.size("spans") > 0).join(live, "row", "left").drop("row", "spans", "content")
    changed, same = changed.filter("cuts is not null").mapInArrow(cut, docs.schema), changed.filter("cuts is null").select(*names)
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    every = found.filter(F.size("spans") == 0).select(*names).unionByName(same).unionByName(changed.select(*names))
    return unpacked(every, columns, kept)
