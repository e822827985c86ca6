import pytest

from sitewise.operators import units as U

RECORD = "row_id long, energy double, energy_unit string, forces array<array<double>>, force_unit string, remark string, value double, unit string, factor double"
READING = "row_id long, feature_name string, reading double, reading_text string, unit string, quantity string"
CONVERSION = [("energy", "eV", "eV", 1.0), ("energy", "meV", "eV", 0.001), ("energy", "rydberg", "eV", 13.6), ("force", "eV/angstrom", "eV/angstrom", 1.0), ("force", "eV/nm", "eV/angstrom", 0.1), ("ratio", "percent", "dimensionless", 0.01), ("ratio", "dimensionless", "dimensionless", 1.0), ("length", "pm", "A", 0.01), ("length", "A", "A", 1.0)]


@pytest.mark.parametrize(
    ("remark", "energy", "force"),
    [
        ("Energies: milli-eV; forces: meV/Å", "meV", "meV/angstrom"),
        ("force components are eV nm^-1, energy is Ry; tolerance 1e-3 eV between cycles", "rydberg", "eV/nm"),
        ("E [kJ·mol⁻¹], F [Ha/Bohr]; smearing 0.01 Ha, no spin", "kJ/mol", "hartree/bohr"),
        ("old exporter, energy column holds 1e-3 eV values", "meV", None),
        ("tolerance 1e-3 eV between cycles", None, None),
        ("cutoff 40 Ry, k-mesh 2x2x2. forces written as Ry/a0", None, "rydberg/bohr"),
        ("total energy in kcal mol^-1", "kcal/mol", None),
        ("energy cutoff 40 Ry", None, None),
        ("", None, None),
        (None, None, None),
        ("x" * 200_000, None, None),
    ],
)
def test_stated_unit(remark, energy, force):
    assert U.stated_unit(remark, "energy") == energy
    assert U.stated_unit(remark, "force") == force


@pytest.mark.parametrize(
    ("text", "quantity", "want"),
    [
        ("E_m (BVSE) = 0.2486 eV", "energy", (0.2486, "eV")),
        ("9,71179 1/nm^3", "number_density", (9.71179, "nm^-3")),
        ("~456.5 pm (read from figure)", "length", (456.5, "pm")),
        ("0.0033 per a0^3", "number_density", (0.0033, "bohr^-3")),
        ("approx. 9.6 Å³", "volume", (9.6, "A^3")),
        ("approx. 58.97 kJ·mol⁻¹", "energy", (58.97, "kJ/mol")),
        ("38,5 %", "ratio", (38.5, "percent")),
        ("-1.5e-3 A", "length", (-0.0015, "A")),
        ("2.05", "energy", (2.05, None)),
        ("no number", "energy", (None, None)),
        (None, "energy", (None, None)),
    ],
)
def test_number_and_unit(text, quantity, want):
    assert U.number_and_unit(text, quantity) == want


def test_normalise(spark):
    rec = spark.createDataFrame([(1, 1000.0, " MeV ", [[1.0, 2.0]], "EV/NM", None, 9.0, "z", 9.0), (2, 2.0, "?", None, None, "total energy in Ry", None, None, None), (3, None, "eV", [[None, 1.0]], None, None, None, None, None), (4, float("nan"), "eV", None, None, None, None, None, None)], RECORD)
    red = spark.createDataFrame([(1, "share", None, "12,5 %", None, None), (2, "share", 3.0, None, "", None), (3, "hop", 300.0, None, "picometre", None), (4, "hop", None, "4 pm", "?", None), (5, "hop", 1.0, None, None, None), (6, "hop", None, None, "pm", None), (7, "other", 1.0, None, "pm", None)], READING)
    man = spark.createDataFrame([("share", "ratio", "dimensionless", "d"), ("hop", "length", "A", "d")], "feature_name string, quantity string, unit string, definition string")
    con = spark.createDataFrame(CONVERSION, "quantity string, source_unit string, canonical_unit string, factor double")
    got = {(r.record_table[:1], r.row_id, r.field_name): (r.source_unit, r.value, r.values) for r in U.normalise(rec, red, man, con).collect()}
    assert got[("i", 1, "energy")][:2] == ("meV", 1.0)
    assert got[("i", 1, "forces")][0] == "eV/nm" and got[("i", 1, "forces")][2] == [[0.1, 0.2]]
    assert got[("i", 2, "energy")][0] == "rydberg" and abs(got[("i", 2, "energy")][1] - 27.2) < 1e-9
    assert got[("i", 3, "forces")] == (None, None, None) and ("i", 3, "energy") not in got
    assert got[("i", 4, "energy")][0] == "eV" and got[("i", 4, "energy")][1] != got[("i", 4, "energy")][1]
    assert got[("d", 1, "reading")] == ("percent", 0.125, None) and got[("d", 2, "reading")][:2] == ("dimensionless", 3.0)
    assert got[("d", 3, "reading")][:2] == ("pm", 3.0) and got[("d", 4, "reading")][:2] == ("pm", 0.04)
    assert got[("d", 5, "reading")][:2] == (None, None) and ("d", 6, "reading") not in got and got[("d", 7, "reading")][:2] == (None, None)
    assert U.normalise(rec.limit(0), red.limit(0), man, con).count() == 0
