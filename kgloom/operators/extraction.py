"""Cleaning and parsing of what a language model extracts, and ids for what has none."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HYPHENS, SPACES
from ..functions.matching import to_ascii

_PLAIN = str.maketrans(HYPHENS + SPACES, "-" * len(HYPHENS) + " " * len(SPACES))
_ODD = re.compile(r"[^\w\-.]", re.ASCII)
# Parts of a name that don't make an id.
SUFFIXES = frozenset("jr sr ii iii iv prof dr phd".split())
_EMPTY: tuple = (None, "", [], {})


@dataclass(frozen=True)
class Slots:
    """What a schema says of its fields."""

    uris: frozenset[str] = frozenset()
    names: tuple[str, ...] = ("name",)
    prefix: str = "kg"


def plain(text: str) -> str:
    """Plain hyphens and spaces, without control and format characters."""
    import unicodedata

    return "".join(c for c in text.translate(_PLAIN) if c in "\n\r\t" or unicodedata.category(c) not in ("Cc", "Cf"))


def _local(text: str) -> str:
    return _ODD.sub("", to_ascii(text).replace(" ", "_"))


def _of_name(name: str) -> str:
    """The last (or else the longest) word of a name and the initials of the others."""
    words = name.split()
    while len(words) > 1 and words[-1].strip(".").lower() in SUFFIXES:
        words.pop()
    if len(words) < 2:
        return _local(words[0] if words else name.strip())
    main = len(words) - 1 if len(_ODD.sub("", to_ascii(words[-1]))) >= 2 else max(range(len(words)), key=lambda i: len(words[i]))
    return _local(words[main] + "_" + "".join(w[0] for i, w in enumerate(words) if i != main))


def fallback_id(item: dict, slots: Slots, document: str = "") -> str:
    """A stable id from a name or another text field, with a digest of the item and its document."""
    name = item.get("name") if "name" in slots.names else None
    local = "entity"
    if isinstance(name, str) and name:
        local = _of_name(name)
    else:
        other = next((item[f] for f in slots.names if isinstance(item.get(f), str) and item[f]), None)
        if other is not None:
            local = _local(other)
            if len(local) > 40:
                cut = local[:40].rfind("_")
                local = local[: cut if cut > 0 else 40]
    digest = hashlib.md5(json.dumps(item | {"_doc": document}, sort_keys=True, default=str).encode()).hexdigest()[:6]
    return f"{slots.prefix}:{local}_{digest}"


def _automatic(ident: str) -> bool:
    ident = ident.strip()
    return ident in ("", "AUTO") or ident.startswith("AUTO:") or ident.endswith((":AUTO", "/AUTO"))


def clean(value: object, slots: Slots, document: str = "") -> object:
    """The value without empty parts and bad links, with plain text and an id for every item that has a name."""
    if isinstance(value, str):
        return plain(value)
    if isinstance(value, list):
        return merge([clean(x, slots, document) for x in value])
    if not isinstance(value, dict):
        return value
    out: dict = {}
    for key, x in value.items():
        x = clean(x, slots, document)
        if key in slots.uris and isinstance(x, str):
            x = x.strip()
            if not re.match(r"https?://\S+$", x):
                continue
        if x == [] or isinstance(x, dict) and x.keys() == {"id"}:
            continue
        out[key] = x
    ident = out.get("id")
    if isinstance(ident, str) and _automatic(ident) or "id" not in out and any(out.get(f) for f in slots.names):
        out["id"] = fallback_id(out, slots, document)
    return out


def merge(items: list) -> list:
    """Items without empty ones; those of equal id become one, its gaps filled by later ones; those without come last."""
    named: dict = {}
    rest = []
    for x in items:
        if x in _EMPTY or isinstance(x, dict) and x.keys() == {"id"} or isinstance(x, str) and x.startswith("AUTO:"):
            continue
        if isinstance(x, dict) and x.get("id"):
            kept = named.setdefault(x["id"], {})
            kept.update((k, v) for k, v in x.items() if not kept.get(k))
        else:
            rest.append(x)
    return [*named.values(), *rest]


#: What a record says of its extraction rather than of the document.
BOOKKEEPING = frozenset("input_text raw_completion_output prompt named_entities extracted_object".split())


def payload(record: dict) -> object:
    """The extracted object of a record, or the record without bookkeeping; lists without nulls and empty objects."""
    found = record.get("extracted_object")
    value = found if found is not None else {k: v for k, v in record.items() if k not in BOOKKEEPING}

    def bare(x: object) -> object:
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items()}
        return [bare(v) for v in x if v is not None and v != {}] if isinstance(x, list) else x

    return bare(value)


def merge_objects(objects: list[dict]) -> dict:
    """Objects of the chunks of a text as one: lists united in order, of other values the last that isn't empty (a zero isn't)."""
    out: dict = {}
    for item in objects:
        for key, value in item.items():
            if isinstance(value, list):
                kept = out.setdefault(key, [])
                kept += [v for i, v in enumerate(value) if v not in kept and v not in value[:i]]
            elif value not in _EMPTY or key not in out:
                out[key] = value
    return out


def ground(value: Column, permitted: list[str]) -> Column:
    """The permitted value that equals ``value`` whatever the case, the first of several; null for others."""
    first = {p.lower(): p for p in reversed(permitted)}
    known = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in first.items()]))
    return F.try_element_at(known, F.lower(value))


@dataclass(frozen=True)
class Slot:
    """A field of a class, as a prompt asks for it and as triples hold it."""

    name: str
    many: bool = False
    description: str = ""
    prompt: str = ""
    values: tuple[str, ...] = ()
    iri: bool = False
    skipped: bool = False


# The wording of a prompt, for texts and for short lines, and of its parts.
PROMPT_TEXT = "From the text below, extract the following entities in the following format:\n\n"
PROMPT_LINE = "Split the following piece of text into fields in the following format:\n\n"
PROMPT_MANY, PROMPT_ONE, PROMPT_VALUES = "semicolon-separated list of {}s", "the value for {}", "Must be one of: "
PROMPT_FRAME = ("\n\nText:\n", "\n\n===\n\n")
#: Longer texts aren't lines.
PROMPT_LINE_LENGTH = 60


def prompt(slots: list[Slot], text: Column) -> Column:
    """What a language model is asked, to fill the fields of a class from a text; a short line is to be split."""
    asked = [s.prompt or s.description or (PROMPT_MANY if s.many else PROMPT_ONE).format(s.name) for s in slots]
    only = [PROMPT_VALUES + ", ".join(s.values) if s.values else "" for s in slots]
    fields = "".join(f"{s.name}: <{a}{o}>\n" for s, a, o in zip(slots, asked, only, strict=True) if not s.skipped)
    line = (F.length(text) <= PROMPT_LINE_LENGTH) & ~F.contains(text, F.lit("\n")) & (text != "")
    return F.concat(F.when(line, PROMPT_LINE).otherwise(PROMPT_TEXT), F.lit(fields + PROMPT_FRAME[0]), text, F.lit(PROMPT_FRAME[1]))


def to_triples(rows: DataFrame, subject: Column, slots: list[Slot], namespace: str, kind: str) -> DataFrame:
    """Triples (s, p, o, o_kind) of records with a column for each slot: their class, and one for each value."""

    def of(slot: Slot) -> Column:
        values = F.col(slot.name) if slot.many else F.array(F.col(slot.name))
        return F.transform(values, lambda v: F.struct(F.lit(namespace + slot.name).alias("p"), v.cast("string").alias("o"), F.lit("iri" if slot.iri else "literal").alias("o_kind")))

    own = F.array(F.struct(F.lit(f"{namespace}type").alias("p"), F.lit(f"{namespace}{kind}").alias("o"), F.lit("iri").alias("o_kind")))
    cells = [own, *map(of, slots)]
    every = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<struct<p:string,o:string,o_kind:string>>")) for c in cells]))
    return rows.select(subject.alias("s"), F.explode(F.filter(every, lambda x: x["o"].isNotNull() & (x["o"] != ""))).alias("x")).select("s", "x.*")


# ---- parsing --------------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^\s*```[\w-]*\s*\n(.*?)\n?\s*```\s*$", re.S)
_FIELD = re.compile(r"^\s*[-*]?\s*(?:\*\*)?([A-Za-z_]\w*)(?:\*\*)?\s*:\s*(.*)$")
_ITEM = re.compile(r"^\s*(?:[-*]|\d+[.)])\s+(.*)$")


def parse(text: str, many: frozenset[str] = frozenset(), fields: frozenset[str] | None = None) -> dict:
    """What a completion says: JSON, fenced or not, or lines ``field: value``.

    Lines that belong to no field continue the one before; list items and ``;`` make several values of fields in
    ``many``; a field may be written in the plural.
    """
    fenced = _FENCE.match(text)
    body = fenced[1] if fenced else text
    try:
        found = json.loads(body)
        if isinstance(found, dict):
            return found
    except ValueError:
        pass
    known = (fields or frozenset()) | many

    def named(name: str) -> str | None:
        name = name.lower()
        for form in (name, name.removesuffix("s"), name + "s"):
            if form in known:
                return form
        return name if not known else None

    out: dict[str, list[str]] = {}
    at: str | None = None
    for line in body.splitlines():
        field = _FIELD.match(line)
        if field and (name := named(field[1])):
            at = name
            out.setdefault(at, [])
            if field[2].strip():
                out[at].append(field[2].strip())
        elif line.strip() and at is not None:
            item = _ITEM.match(line)
            if item or not out[at] or at in many:
                out[at].append((item[1] if item else line).strip())
            else:
                out[at][-1] += " " + line.strip()
    return {k: [p.strip() for x in v for p in x.split(";") if p.strip()] if k in many else " ".join(v) for k, v in out.items()}


def iter_chunks(text: str, size: int) -> Iterator[str]:
    """Pieces of at most ``size`` characters, one by one, cut at sentence ends where there are any."""
    at = 0
    while at < len(text):
        piece = text[at : at + size]
        if at + size < len(text):
            piece = piece[: max((m.end() for m in re.finditer(r"[.!?]\s", piece)), default=size)]
        yield piece
        at += len(piece)


def chunks(text: str, size: int) -> list[str]:
    return list(iter_chunks(text, size))


def clean_udf(slots: Slots):
    """A UDF (json, document) -> cleaned json."""

    @F.pandas_udf("string")
    def run(text: pd.Series, document: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json.dumps(clean(json.loads(t), slots, d or ""), ensure_ascii=False, sort_keys=True) for t, d in zip(text, document, strict=True)])

    return run


def merge_udf():
    """A UDF: an array of json items -> the json list of ``merge``."""

    @F.pandas_udf("string")
    def run(items: pd.Series) -> pd.Series:
        return items.map(lambda xs: None if xs is None else json.dumps(merge([json.loads(x) for x in xs]), ensure_ascii=False, sort_keys=True))

    return run


def merge_objects_udf():
    """A UDF: an array of json objects -> the json object of ``merge_objects``."""

    @F.pandas_udf("string")
    def run(items: pd.Series) -> pd.Series:
        return items.map(lambda xs: None if xs is None else json.dumps(merge_objects([json.loads(x) for x in xs]), ensure_ascii=False, sort_keys=True))

    return run


def payload_udf():
    """A UDF: a record as json -> its payload as json."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else json.dumps(payload(json.loads(t.replace("\0", ""))), ensure_ascii=False, sort_keys=True))

    return run


def parse_udf(many: frozenset[str] = frozenset(), fields: frozenset[str] | None = None):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else json.dumps(parse(t, many, fields), ensure_ascii=False, sort_keys=True))

    return run


@F.udtf(returnType="n: int, chunk: string")
class ChunkTable:
    """A table function: the pieces of a text as rows, one by one, however long the text; null has none."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(iter_chunks(text or "", size))
