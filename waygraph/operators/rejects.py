"""Route lines: good records, and the bad lines with the reason.

A block of lines is parsed at once by a columnar JSON reader with a fixed schema. A block that fails
is cut in two, and again, until the bad lines stand alone; those are read strictly, character by
character as the standard has it, for the reason. Lines of a batch are put in order of suspicion
first, by a pattern matched over the whole column: bad lines then lie together, most blocks are read
once, and a wrong suspicion costs time only. Only lines that the columnar reader cannot confuse with a
neighbour (one opening brace at the start, one closing brace at the end) enter a block; the others are
read strictly as well, and so are lines with a bare NaN or Inf anywhere, which that reader takes for a
number, and lines with many brackets.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: white space of the JSON standard
SPACE = " \t\r\n"
#: a value that the columnar reader accepts and the standard does not; in a string it is a false alarm
_NO_JSON = r"[:,\[][ \t]*-?(?:NaN|Inf)"
#: more opening brackets than this are read strictly: the columnar reader's depth is not known
_BRACKETS = 32
_STRING = r'"(?:[^"\\\x00-\x1f]|\\.)*"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_GAP = r"[ \t]*"
_LIST = rf"\[{_GAP}{_NUMBER}{_GAP}(?:,{_GAP}{_NUMBER}{_GAP})*\]"
_PAIR = rf"{_STRING}{_GAP}:{_GAP}(?:{_STRING}|{_NUMBER}|{_LIST}|true|false|null){_GAP}"
#: a flat object with text, numbers and lists of numbers
_USUAL = rf"^\{{{_GAP}{_PAIR}(?:,{_GAP}{_PAIR})*\}}$"
#: a field of a route record with a value of another kind
_OTHER = rf'"(?:lat|lng)"{_GAP}:{_GAP}[^\[ \t]|"(?:RouteId|RouteVarId)"{_GAP}:{_GAP}[^" \t]'
_FIELDS = ("RouteId", "RouteVarId", "lat", "lng")
_SCHEMA = pa.schema([("RouteId", pa.string()), ("RouteVarId", pa.string()), ("lat", pa.list_(pa.float64())), ("lng", pa.list_(pa.float64()))])
_OUT = "line_id long, feed string, status string, reason string, RouteId string, RouteVarId string, lat array<double>, lng array<double>"


class _Bad(ValueError):
    pass


def _no_constant(name: str) -> float:
    raise _Bad(f"not_finite: {name}")


def _whole(digits: str) -> int:
    # a number of so many digits is out of every range; the rest of it is not converted
    return int(digits if len(digits) < 1000 else digits[:400])


_TOKEN = re.compile(rf'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{{4}}))*")|({_NUMBER}|true|false|null)|([\[\]{{}},:]))')


def _nested(body: str) -> object:
    """The value of a document that is nested too deep for recursion; what lies below its second level is left out."""
    at, stack, root, key, after = 0, [], None, None, "start"

    def bad() -> ValueError:
        return _Bad(f"syntax: unexpected at {at}")

    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            if body[at:].strip(SPACE) == "":
                break
            raise bad()
        text, scalar, mark = m.groups()
        inside = stack[-1][0] if stack else None
        ready = after in ("start", ":", "[") or (after == "," and inside == "[")
        if mark in ("]", "}"):
            if inside != {"]": "[", "}": "{"}[mark] or after in (",", ":", "key"):
                raise bad()
            stack.pop()
            after = "value"
        elif mark == ",":
            if not stack or after != "value":
                raise bad()
            after = ","
        elif mark == ":":
            if after != "key":
                raise bad()
            after = ":"
        elif text and inside == "{" and after in ("{", ","):
            key = json.loads(text) if len(stack) == 1 else None
            after = "key"
        elif not ready:
            raise bad()
        else:
            value = [] if mark == "[" else {} if mark == "{" else json.loads(text or scalar, parse_int=_whole)
            if not stack:
                root = value
            elif len(stack) == 1 and inside == "{":
                root[key] = value
            elif len(stack) <= 2 and inside == "[":
                stack[-1][1].append(value)
            if mark:
                stack.append((mark, value))
            after = mark or "value"
        at = m.end()
    if stack or after == "start":
        raise bad()
    return root


def diagnose(body: str) -> tuple[str | None, dict | None]:
    """(reason, None) of a bad line or (None, record) of a good one, by the strict rules.

    Reasons: syntax, not_finite, not_object, missing_field, id_not_text, not_array, empty_array,
    unequal_length, not_number, out_of_range, each with a detail after a colon. Depth of nesting and
    length of numbers make no line bad. Half a surrogate pair in an id becomes U+FFFD.
    """
    try:
        try:
            record = json.loads(body.strip(SPACE), parse_constant=_no_constant, parse_int=_whole)
        except RecursionError:
            record = _nested(body)
    except _Bad as e:
        return str(e), None
    except ValueError as e:
        return f"syntax: {getattr(e, 'msg', 'unreadable')} at {getattr(e, 'pos', 0)}", None
    if not isinstance(record, dict):
        return f"not_object: {type(record).__name__}", None
    for name in _FIELDS:
        if name not in record:
            return f"missing_field: {name}", None
    for name in _FIELDS[:2]:
        if not isinstance(record[name], str) or not record[name]:
            return f"id_not_text: {name}", None
    for name in _FIELDS[2:]:
        if not isinstance(record[name], list):
            return f"not_array: {name}", None
        if not record[name]:
            return f"empty_array: {name}", None
    if len(record["lat"]) != len(record["lng"]):
        return f"unequal_length: {len(record['lat'])} and {len(record['lng'])}", None
    for name, most in (("lat", 90), ("lng", 180)):
        for i, x in enumerate(record[name]):
            if type(x) not in (int, float):
                return f"not_number: {name}[{i}]", None
            if type(x) is float and not math.isfinite(x):
                return f"not_finite: {name}[{i}]", None
            if not -most <= x <= most:
                return f"out_of_range: {name}[{i}]", None
    whole = lambda t: t.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return None, {k: whole(record[k]) if k in _FIELDS[:2] else [float(x) for x in record[k]] for k in _FIELDS}


def _bulk(lines: list[bytes]) -> pa.Table | None:
    """The lines as a table, one row a line; None when the block as a whole cannot be read."""
    data = b"\n".join(lines)
    try:
        t = pj.read_json(
            pa.BufferReader(data), read_options=pj.ReadOptions(use_threads=False, block_size=len(data) + 64),
            parse_options=pj.ParseOptions(explicit_schema=_SCHEMA, unexpected_field_behavior="ignore"),
        )
    except pa.ArrowInvalid:
        return None
    return t.select(list(_FIELDS)).combine_chunks() if t.num_rows == len(lines) else None


def _good_rows(t: pa.Table) -> np.ndarray:
    """Which rows of a bulk-parsed block meet all rules of a route record."""
    ok = np.ones(t.num_rows, dtype=bool)
    for name in _FIELDS[:2]:
        ok &= pc.fill_null(pc.greater(pc.utf8_length(t.column(name)), 0), False).to_numpy()
    sizes = []
    for name, most in (("lat", 90.0), ("lng", 180.0)):
        col = pa.concat_arrays(t.column(name).chunks) if t.num_rows else pa.array([], pa.list_(pa.float64()))
        n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        v = pc.fill_null(col.flatten(), np.nan).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            bad = np.append(0, np.cumsum(~((v >= -most) & (v <= most))))
        end = np.cumsum(n)
        ok &= (n > 0) & (bad[end] == bad[end - n])
        sizes.append(n)
    return ok & (sizes[0] == sizes[1])


def _isolate(lines: list[bytes], at: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table | None]]:
    """(line numbers, their table); (one line number, None) for a line that fails alone."""
    if not len(lines):
        return
    t = _bulk(lines)
    if t is not None:
        yield at, t
    elif len(lines) == 1:
        yield at, None
    else:
        h = len(lines) // 2
        yield from _isolate(lines[:h], at[:h])
        yield from _isolate(lines[h:], at[h:])


def _parse(batch: pa.RecordBatch) -> pa.RecordBatch:
    body = batch.column("body")
    text = pc.utf8_trim(pc.fill_null(body, ""), SPACE)
    blank = pc.equal(pc.binary_length(pc.utf8_trim_whitespace(text)), 0).to_numpy(zero_copy_only=False)
    plain = pc.and_(pc.equal(pc.count_substring(text, "{"), 1), pc.equal(pc.count_substring(text, "}"), 1))
    plain = pc.and_(plain, pc.and_(pc.starts_with(text, "{"), pc.ends_with(text, "}"))).to_numpy(zero_copy_only=False)
    # a line break inside a line would be two lines of a block
    plain &= ~pc.match_substring_regex(text, "[\r\n]").to_numpy(zero_copy_only=False)
    plain &= ~pc.match_substring_regex(text, _NO_JSON).to_numpy(zero_copy_only=False)
    plain &= pc.less_equal(pc.count_substring(text, "["), _BRACKETS).to_numpy(zero_copy_only=False)
    status = np.where(blank, "blank", "bad").astype(object)
    reason = np.full(len(text), None, dtype=object)
    odd = ~pc.match_substring_regex(text, _USUAL).to_numpy(zero_copy_only=False) | pc.match_substring_regex(text, _OTHER).to_numpy(zero_copy_only=False)
    at = np.concatenate([np.flatnonzero(plain & ~blank & ~odd), np.flatnonzero(plain & ~blank & odd)])
    strict = [np.flatnonzero(~plain & ~blank)]
    tables, places = [], []
    lines, usual = text.take(pa.array(at)).cast(pa.binary()).to_pylist(), int((~odd[at]).sum())
    for where, t in (*_isolate(lines[:usual], at[:usual]), *_isolate(lines[usual:], at[usual:])):
        if t is None:
            strict.append(where)
        else:
            tables.append(t)
            places.append(where)
    if tables:
        t, where = pa.concat_tables(tables).combine_chunks(), np.concatenate(places)
        ok = _good_rows(t)
        strict.append(where[~ok])
        tables, places = [t.filter(pa.array(ok))], [where[ok]]
    found: list[dict] = []
    late = []
    for i in np.concatenate(strict):
        reason[i], record = diagnose(text[int(i)].as_py())
        if record:
            found.append(record)
            late.append(i)
    if found:
        tables.append(pa.Table.from_pylist(found, schema=_SCHEMA))
        places.append(np.array(late))
    if places:
        status[np.concatenate(places)] = "good"
    every = pa.concat_tables([*tables, _SCHEMA.empty_table()]).combine_chunks()
    slot = np.full(len(text), -1)
    if places:
        slot[np.concatenate(places)] = np.arange(every.num_rows)
    pick = every.take(pa.array(slot, mask=slot < 0))
    cols = [batch.column("line_id").cast(pa.int64()), batch.column("feed"), pa.array(status, pa.string()), pa.array(reason, pa.string())]
    cols += [pa.concat_arrays(pick.column(k).chunks) if pick.num_rows else pa.array([], _SCHEMA.field(k).type) for k in _FIELDS]
    return pa.RecordBatch.from_arrays(cols, names=["line_id", "feed", "status", "reason", *_FIELDS])


def parsed_lines(df: DataFrame) -> DataFrame:
    """(line_id, feed, status, reason, RouteId, RouteVarId, lat, lng): every line read, status good, bad or blank.

    df: line_id, feed, body. A null or white-space body is blank. Record columns are null unless good,
    reason is null unless bad. Repeated rows (same line_id and body) count once. Extra columns are
    ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _parse(b)

    # the body is not shuffled whole to find repeats: they are parsed twice and dropped by key and content
    read = df.select("line_id", "feed", "body").mapInArrow(run, _OUT)
    return read.dropDuplicates(["line_id", "status", "reason", *_FIELDS])


def good_routes(df: DataFrame) -> DataFrame:
    return parsed_lines(df).where("status = 'good'").select("line_id", "feed", *_FIELDS)


def bad_lines(df: DataFrame) -> DataFrame:
    return parsed_lines(df).where("status = 'bad'").select("line_id", "feed", "reason")
