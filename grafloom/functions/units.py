"""Units of measurement: spellings, conversion, and finding a unit in a text."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values. Parameter type -> units; a unit -> (factor, offset, spellings):
# value in the common unit = (value - offset) * factor. The first unit of a
# type, with factor 1 and offset 0, is the common one. Spellings are compared
# without case, blanks and dots, after folding of look-alikes.
UNITS: dict[str, dict[str, tuple[float, float, list[str]]]] = {
    "temperature": {
        "°C": (1.0, 0.0, ["°C", "C", "celsius", "degC", "deg. C", "Grad C", "Grad Celsius", "degrees Celsius"]),
        "K": (1.0, 273.15, ["K", "Kelvin"]),
        "°F": (5.0 / 9.0, 32.0, ["°F", "F", "Fahrenheit", "degF", "deg. F", "Grad F", "Grad Fahrenheit", "degrees Fahrenheit"]),
    },
    "pressure": {
        "kPa": (1.0, 0.0, ["kPa", "kilopascal", "kilopascals"]),
        "Pa": (0.001, 0.0, ["Pa", "pascal", "pascals"]),
        "hPa": (0.1, 0.0, ["hPa", "hektopascal", "hectopascal"]),
        "mbar": (0.1, 0.0, ["mbar", "millibar", "mb"]),
        "bar": (100.0, 0.0, ["bar", "bars"]),
        "MPa": (1000.0, 0.0, ["MPa", "megapascal", "N/mm²", "N/mm^2"]),
        "psi": (6.894757293168361, 0.0, ["psi", "lbf/in²", "lb/in²", "lbf/in^2"]),
    },
    "speed": {
        "mm/s": (1.0, 0.0, ["mm/s", "mm/sec", "mm·s⁻¹", "mm s⁻¹", "mm/Sek."]),
        "m/s": (1000.0, 0.0, ["m/s", "m/sec", "m·s⁻¹", "m s⁻¹"]),
        "m/min": (1000.0 / 60.0, 0.0, ["m/min", "m min⁻¹", "m·min⁻¹"]),
        "cm/min": (10.0 / 60.0, 0.0, ["cm/min", "cm min⁻¹", "cm·min⁻¹"]),
        "in/min": (25.4 / 60.0, 0.0, ["in/min", "inch/min", "ipm"]),
    },
    "current": {
        "A": (1.0, 0.0, ["A", "Amp", "Amps", "Ampere", "Amperes"]),
        "mA": (0.001, 0.0, ["mA", "milliamp", "milliamps", "Milliampere"]),
        "kA": (1000.0, 0.0, ["kA", "kiloamp", "Kiloampere"]),
    },
    "voltage": {
        "V": (1.0, 0.0, ["V", "Volt", "Volts"]),
        "mV": (0.001, 0.0, ["mV", "Millivolt", "millivolts"]),
        "kV": (1000.0, 0.0, ["kV", "Kilovolt", "kilovolts"]),
    },
    "flow_rate": {
        "l/min": (1.0, 0.0, ["l/min", "Liter/min", "lpm", "litres/min", "liters/min"]),
        "l/h": (1.0 / 60.0, 0.0, ["l/h", "Liter/Std.", "Liter/h", "l/hr"]),
        "m³/h": (1000.0 / 60.0, 0.0, ["m³/h", "cbm/h", "m^3/h"]),
        "ml/s": (0.06, 0.0, ["ml/s", "ml/sec"]),
        "ft³/h": (28.316846592 / 60.0, 0.0, ["ft³/h", "CFH", "cu ft/h"]),
    },
    "force": {
        "N": (1.0, 0.0, ["N", "Newton", "newtons"]),
        "kN": (1000.0, 0.0, ["kN", "Kilonewton", "kilonewtons"]),
        "kgf": (9.80665, 0.0, ["kgf", "kp", "Kilopond"]),
        "lbf": (4.4482216152605, 0.0, ["lbf", "lb-f", "pound-force"]),
    },
    "time": {
        "s": (1.0, 0.0, ["s", "sec", "secs", "second", "seconds", "Sek.", "Sekunde", "Sekunden"]),
        "ms": (0.001, 0.0, ["ms", "msec", "Millisekunden", "milliseconds", "millisecond"]),
        "min": (60.0, 0.0, ["min", "Min.", "minute", "minutes", "Minuten", "mins"]),
        "h": (3600.0, 0.0, ["h", "hr", "hrs", "hour", "hours", "Std.", "Stunde", "Stunden"]),
    },
    "distance": {
        "mm": (1.0, 0.0, ["mm", "Millimeter", "millimetres", "millimeters", "millimetre"]),
        "cm": (10.0, 0.0, ["cm", "Zentimeter", "centimetres", "centimeters", "centimetre"]),
        "m": (1000.0, 0.0, ["m", "Meter", "metres", "meters", "metre"]),
        "in": (25.4, 0.0, ["in", "inch", "inches", "Zoll", "″", '"']),
        "µm": (0.001, 0.0, ["µm", "um", "micron", "microns", "Mikrometer", "micrometre", "micrometer"]),
    },
}

_FOLD = str.maketrans({"μ": "µ", "²": "2", "³": "3", "⁻": "-", "−": "-", "¹": "1", "·": "", "*": "", "^": "", "º": "°", "℃": "°c", "℉": "°f", "″": '"', "”": '"', "K": "k"})
_NUMBER = re.compile(r"(?<![\w.,])[-+]?(?:\d{1,3}(?:[.,' ]\d{3}(?!\d))+|\d+)(?:[.,]\d+)?")


def spelling(text: str) -> str:
    return re.sub(r"[\s.\xa0]+", "", text.translate(_FOLD).lower())


@lru_cache(maxsize=None)
def vocabulary(kind: str | None) -> dict[str, tuple[str, str]]:
    """Spelling -> (type, unit), of one type or of all."""
    kinds = [kind] if kind in UNITS else list(UNITS) if kind is None else []
    return {spelling(s): (k, u) for k in kinds for u, (_, _, names) in UNITS[k].items() for s in names}


@lru_cache(maxsize=None)
def _mention(kind: str | None) -> re.Pattern:
    """A unit in a running text; blanks may stand within compound spellings."""
    kinds = [kind] if kind in UNITS else list(UNITS)
    forms = {s for k in kinds for _, _, names in UNITS[k].values() for s in names} | {"℃", "℉"} & ({"℃", "℉"} if "temperature" in kinds else set())
    forms |= {s.replace("µ", "μ") for s in forms} | {s.replace("²", "2").replace("³", "3") for s in forms}
    parts = []
    for form in sorted(forms, key=lambda s: (-len(s), s)):
        body = re.sub(r"(\\ )+", r"\\s*", re.escape(form)).replace("/", r"\s*/\s*").replace(r"\.", r"\.?")
        # A single letter must have its own case: 'a' is an article, 'A' a unit.
        parts.append(body if len(form) == 1 else f"(?i:{body})")
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(parts)})(?![\w/°²³⁻·])")


def unit_of(text: str | None, kind: str | None) -> tuple[str, str] | None:
    """(type, unit) that a unit field names, or None."""
    return vocabulary(kind).get(spelling(text)) if text else None


def mentions(text: str | None, kind: str | None) -> list[tuple[str, str]]:
    """The units of the type named anywhere in a short remark, in order. The
    preposition 'in' before a unit is none."""
    found = [vocabulary(kind).get(spelling(m.group())) for m in _mention(kind).finditer(text or "")]
    return [f for i, f in enumerate(found) if f and not (f[1] == "in" and i + 1 < len(found))]


def last_mention(text: str | None, kind: str | None) -> tuple[str, str] | None:
    return (mentions(text, kind) or [None])[-1]


def _numbers(token: str) -> set[float]:
    """What a written number may mean: comma or dot as decimal sign, or as
    grouping."""
    out = set()
    for text in (token.replace(",", "."), re.sub(r"[.' ](?=\d{3})", "", token).replace(",", "."), re.sub(r"[,' ](?=\d{3})", "", token)):
        try:
            out.add(float(text.replace(" ", "")))
        except ValueError:
            pass
    return out


def mentions_at_value(text: str | None, value: float, kind: str | None) -> list[tuple[str, str]]:
    """The units that follow the given value in a text; other numbers with a
    unit (a duration, a place) are passed over."""
    out = []
    if not text or value != value:
        return out
    for m in _NUMBER.finditer(text):
        if any(abs(x - value) <= 1e-6 * max(1.0, abs(value)) for x in _numbers(m.group())):
            rest = re.compile(r"\s*").match(text, m.end()).end()
            unit = _mention(kind).match(text, rest) if rest == m.end() or text[rest - 1].isspace() else None
            if unit and (found := vocabulary(kind).get(spelling(unit.group()))):
                out.append(found)
    return out


# A unit at the end of a name: in brackets, after a slash, a comma or 'in'.
_ANNOTATION = re.compile(r"(?:[\[(]\s*([^\])]+?)\s*[\])]|\s/\s*(\S.*?)|,\s+(\S.*?)|\s(?:in|per)\s+(\S.*?))\s*$", re.IGNORECASE)


def annotation(name: str | None, kind: str | None) -> tuple[str, str] | None:
    """(type, unit) that a parameter's name is annotated with, or None."""
    at = 0
    while name and (m := _ANNOTATION.search(name, at)):
        if found := unit_of(next(g for g in m.groups() if g), kind):
            return found
        at = m.start() + 1
    return None


def named_units(unit: str | None, name: str | None, description: str | None, source_text: str | None, value: float, kind: str | None) -> tuple[str, list[str]] | None:
    """(type, units) from the unit field or, if that says nothing, from the
    name's own annotation, the description or the source text, whichever says
    something first. A text may name several units; those of the type of the
    last one are given."""
    if found := unit_of(unit, kind) or annotation(name, kind):
        return found[0], [found[1]]
    if found := mentions(description, kind) or mentions_at_value(source_text, value, kind):
        return found[-1][0], list(dict.fromkeys(u for k, u in found if k == found[-1][0]))
    return None
