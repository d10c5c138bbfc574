"""What the tests of this folder share."""

#: A small table with a null, an empty and a very long text, repeated rows, copies, a null id, and columns named like results.
LONG = "long words go on " * 12_000
TEXTS = [
    (1, "Plain words, and more of them; the end."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, LONG),
    (6, "Mail bosbt.42@mail8.example.com or +1 (988) 555-2485, from 42.144.35.254 with 4041894974608795."),
    (6, "Mail bosbt.42@mail8.example.com or +1 (988) 555-2485, from 42.144.35.254 with 4041894974608795."),
    (7, "Plain words, and more of them; the end."),
    (None, "no id here <|endoftext|> é日本語 😀 end"),
    (None, None),
    (8, "x"),
]


def tuples(df, *columns):
    """The rows, in an order that does not depend on how they came."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
