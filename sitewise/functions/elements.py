"""Element symbols and the blocks of the periodic table, by atomic number."""

from __future__ import annotations

#: The element symbols in order of atomic number, from 1.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER_OF = {s: i for i, s in enumerate(SYMBOLS, 1)}


def symbols_of(*spans: tuple[int, int]) -> list[str]:
    """The symbols of spans of atomic numbers, both ends included."""
    return [SYMBOLS[z - 1] for a, b in spans for z in range(a, b + 1)]


#: The transition metals, lanthanum and actinium among them, and the lanthanides after lanthanum.
D_BLOCK = symbols_of((21, 30), (39, 48), (57, 57), (72, 80), (89, 89), (104, 112))
F_BLOCK = symbols_of((58, 71))
