"""Units in SQL, for checking: read by patterns of their grammar, without the operator's table of spellings."""

from __future__ import annotations

_E = {
    "meV": r"mev|(?:milli-?|1e-3 |10\^-3 )(?:ev|electron ?volts?)",
    "eV": r"ev|electron ?volts?",
    "hartree": r"ha|eh|hartrees?",
    "rydberg": r"ry|ryd|rydbergs?",
    "kJ/mol": r"kj(?:/| per | )mol(?:\^?-1)?",
    "kcal/mol": r"kcal(?:/| per | )mol(?:\^?-1)?",
}
_L = {"A": r"a|ang|angstroms?", "nm": r"nm|nanomet(?:re|er)s?", "pm": r"pm|picomet(?:re|er)s?", "bohr": r"bohr|a_?0|au|a\.u\."}
_per = lambda e, x: rf"(?:{_E[e]})(?:/| / | per | )(?:{_L[x]})(?:\^?-1)?"
UNITS = {
    "energy": _E,
    "force": {"meV/angstrom": _per("meV", "A"), "eV/angstrom": _per("eV", "A"), "eV/nm": _per("eV", "nm"), "hartree/bohr": _per("hartree", "bohr"), "rydberg/bohr": _per("rydberg", "bohr")},
    "length": _L,
    "volume": {f"{u}^3": rf"(?:{_L[u]})\^?3|cubic (?:{_L[u]})" for u in ("A", "nm", "bohr")},
    "number_density": {f"{u}^-3": rf"(?:{_L[u]})\^?-3|(?:1/|/|per )(?:{_L[u]})\^?3|per cubic (?:{_L[u]})" for u in ("A", "nm", "bohr")},
    "ratio": {"percent": r"%|pct|per ?cent", "dimensionless": r"-|1|dimensionless|"},
}


def folded(text: str) -> str:
    """One spelling of signs: small letters, a for å, plain minus and digits, · as a blank."""
    out = f"lower({text})"
    for a, b in (("å", "a"), ("å", "a"), ("⁻", "-"), ("−", "-"), ("³", "3"), ("¹", "1")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '\\s*[·*⋅]\\s*|\\s+', ' ', 'g'))"


def unit_of(text: str, quantity: str) -> str:
    """The unit that a whole text is, null if it is none of the quantity."""
    return "case " + " ".join(f"when regexp_full_match({folded(text)}, '(?:{p})') then '{u}'" for u, p in UNITS[quantity].items()) + " end"


def stated(text: str, field: str) -> str:
    """What a remark says in the place of a field's unit: the field's word, then without a digit or a new clause a unit."""
    word = {"energy": r"\b(?:energy|energies|e)\b", "force": r"\b(?:forces?|f)\b"}[field]
    every = "|".join(UNITS[field].values())
    return f"regexp_extract({folded(text)}, '{word}[^;.0-9]*?(?:[\\s:\\[])({every})(?:$|[\\s,;.\\]])', 1)"


def record_unit(column: str, field: str) -> str:
    """The unit of a record's field: that of its column, else the one stated in the remark."""
    return f"coalesce({unit_of(column, field)}, {unit_of(stated('remark', field), field)})"


#: The number of a reading's text that stands by itself, and what follows it.
NUMBER = r"(?:^|[^\w^.,])([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)\s*(.*?)(?:\s*\(read from figure\))?$"

VALUES = f"""v as (
  select 'inference_record' as record_table, row_id, 'energy' as field_name, 'energy' as quantity, null as common, energy as given, null::double[][] as given_values, {record_unit('energy_unit', 'energy')} as source_unit from inference_record where energy is not null
  union all select 'inference_record', row_id, 'forces', 'force', null, null, forces, {record_unit('force_unit', 'force')} from inference_record where forces is not null
  union all select 'descriptor_value', row_id, 'reading', quantity, common, given, null, case quantity {' '.join(f"when '{q}' then coalesce({unit_of('unit', q)}, {unit_of('after', q)})" for q in UNITS if q != 'force')} end
    from (select d.row_id, m.quantity, m.unit as common, d.unit, coalesce(d.reading, try_cast(replace(regexp_extract(reading_text, '{NUMBER}', 1), ',', '.') as double)) as given, nullif(regexp_extract(reading_text, '{NUMBER}', 2), '') as after
      from descriptor_value d left join descriptor_fallback_manifest m using (feature_name)) where given is not null),
f as (select v.*, c.canonical_unit as common_unit, c.factor from v left join unit_conversion c on c.quantity = v.quantity and c.source_unit = v.source_unit)"""
