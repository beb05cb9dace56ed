"""Rows that the operators' tests share."""

#: Nulls, empty and very long texts, ties, repeated rows, near and exact copies, a third of all rows alike.
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(80))
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One"), (6, "Étoile ÉTOILE"), (7, "étoile étoile"), (8, LONG), (9, LONG + " tail"),
    (10, BASE), (11, BASE), (12, BASE.upper()), (13, BASE.replace("alpha40", "gamma")), (14, "start " + PASSAGE + " end"), (15, PASSAGE + " more " + PASSAGE),
    (16, "word " * 400), (None, "no id here"), (None, BASE), (17, "repeated row " + PASSAGE), (17, "repeated row " + PASSAGE), (18, "a\x00b é x \U0001f600 " * 30),
    *((100 + i, "hot text of a third of all rows, said again and again " * 8) for i in range(12)),
]
