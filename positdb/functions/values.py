"""Values of eight types in one set of columns.

``vt`` tells the type.  ``v_text`` is the display, ``v_key`` equal for equal values of a type, ``v_num`` the number of
integers and of decimals that fit 38 digits, ``v_cert`` the percentage of certainties, ``v_prec``, ``v_lo`` and
``v_hi`` the encoding of times.
"""

import json
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from positdb.errors import ExecutionError
from positdb.functions import times

CERTAINTY, STRING, MOMENT, DATE, INTEGER, DECIMAL, JSON, TIME = range(1, 9)
NAMES = {CERTAINTY: "Certainty", STRING: "String", MOMENT: "NaiveDateTime", DATE: "NaiveDate", INTEGER: "i64", DECIMAL: "Decimal", JSON: "JSON", TIME: "Time"}
NUMBERS = {INTEGER, DECIMAL}
COLUMNS = "vt tinyint, v_text string, v_key string, v_num decimal(38,18), v_cert int, v_prec tinyint, v_lo long, v_hi long"
NUMBER = "decimal(38,18)"


@dataclass(frozen=True)
class Value:
    vt: int
    text: str
    key: str
    num: Decimal | None = None
    cert: int | None = None
    time: times.Time | None = None

    def row(self) -> tuple:
        t = self.time
        return (self.vt, self.text, self.key, self.num, self.cert, *((t.prec, t.lo, t.hi) if t else (None, None, None)))


def fits(number: Decimal) -> Decimal | None:
    """The number at the scale of ``v_num``, if it fits without loss."""
    with localcontext() as c:
        c.prec = 60
        try:
            scaled = number.quantize(Decimal(1).scaleb(-18))
        except InvalidOperation:
            return None
        return scaled if scaled == number and abs(scaled) < Decimal(10) ** 20 else None


def canonical(number: Decimal) -> str:
    """The same text for 10, 10.0 and 1E1."""
    text = format(number, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def string(text: str) -> Value:
    return Value(STRING, text, text)


def integer(text: str) -> Value:
    n = int(text)
    if not -(2**63) <= n < 2**63:
        raise ExecutionError(f"{text} does not fit 64 bits")
    return Value(INTEGER, str(n), str(n), fits(Decimal(n)))


def decimal(text: str) -> Value:
    d = Decimal(text)
    return Value(DECIMAL, text.lstrip("+"), canonical(d), fits(d))


def shown_certainty(percent: int) -> str:
    """0.75, -0.05, 1 and 0."""
    if percent % 100 == 0:
        return str(percent // 100)
    return f"{'-' if percent < 0 else ''}0.{abs(percent):02d}"


def certainty(text: str) -> Value:
    """``75%``; beyond 100 percent it saturates."""
    n = max(-100, min(100, int(text.rstrip("%"))))
    return Value(CERTAINTY, shown_certainty(n), str(n), None, n)


def document(text: str) -> Value:
    """JSON; equal documents have equal keys, whatever the order of their members and their white space."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ExecutionError(f"Not a JSON document: {e}") from None
    key = json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return Value(JSON, key, key)


def time(t: times.Time) -> Value:
    return Value(TIME, t.text, f"{t.prec}:{t.lo}", None, None, t)


def unescape(quoted: str) -> str:
    """The text of a string literal; two quotes stand for one."""
    return quoted[1:-1].replace('""', '"')


def columns(vt: int, value: Column) -> list[Column]:
    """Value columns from a column of a table: bulk counterpart of the literals."""
    text, num, cert = value.cast("string"), F.lit(None), F.lit(None)
    key, prec, lo, hi = text, F.lit(None), F.lit(None), F.lit(None)
    if vt == INTEGER:
        num = value.cast("long").cast(NUMBER)
    elif vt == DECIMAL:
        num = value.cast(NUMBER)
        plain = F.regexp_replace(F.regexp_replace(num.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        text = key = F.when(plain == "-0", F.lit("0")).otherwise(plain)
    elif vt == CERTAINTY:
        cert = F.greatest(F.lit(-100), F.least(F.lit(100), value.cast("int")))
        key = cert.cast("string")
        text = F.when(cert % 100 == 0, (cert / 100).cast("int").cast("string")).otherwise(F.concat(F.when(cert < 0, "-").otherwise(""), F.lit("0."), F.lpad(F.abs(cert).cast("string"), 2, "0")))
    elif vt == JSON:
        text = key = F.to_json(F.parse_json(value))  # variants keep members sorted by name
    elif vt == TIME:
        lo = times.micros(value.cast("timestamp_ntz"))
        prec, hi = F.lit(times.MOMENT), lo
        text, key = times.shown(prec, lo), F.concat(F.lit(f"{times.MOMENT}:"), lo.cast("string"))
    cast = {"vt": (F.lit(vt), "tinyint"), "v_text": (text, "string"), "v_key": (key, "string"), "v_num": (num, NUMBER), "v_cert": (cert, "int"), "v_prec": (prec, "tinyint"), "v_lo": (lo, "long"), "v_hi": (hi, "long")}
    return [c.cast(kind).alias(name) for name, (c, kind) in cast.items()]
