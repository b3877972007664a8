"""Passages and quotations that say what the verifier must accept and what it must refuse."""

#: (document, page, text, from a scan)
PASSAGES = [
    ("D1", 1, "You pay 50% of fees when due. A fee costs $1,500 a year. The rate is 1.5 percent.", False),
    ("D2", 1, "You deliver in 30 days, pay in 60 days. It is due in 30. Then stop.", False),
    ("D3", 1, "A party may not assign this. It shall not exceed the cap. It takes less than ten days.", False),
    ("D4", 1, "A written notice is needed. But such notice is not needed here.", False),
    ("D5", 1, "First rule. Second rule. So either party, on written notice, may end it. But either side shall not end it.", False),
    ("D6", 1, "This is text across\nlines. It has “curly” and ‘single’ marks. The ﬁnal oﬃce is here.", False),
    ("D7", 1, "The liability² is capped[3] by law. The termi-\nnation date is near. Here section 12.\n1 applies. It takes 1½ days.", False),
    ("D8", 1, "This page is long enough and the sentence that matters begins right here and then", False),
    ("D8", 2, "goes on over the page until it ends. The passage repeats. The passage repeats.", False),
    ("D8", 3, "Only this third page mentions the appendix.", False),
    ("D9", 1, "The supplier will deliver every replacement component to the warehouse within 14 working days of the written request.", False),
    ("D10", 1, "This line was read from a scanned page.", True),
    ("D12", 1, "A written notice is needed.", False),
    ("D11", 1, "b comes then a follows", False),
]

_SLIP = "The supplier will deliver every replacment component to the warehouse within 14 working days of the written request."

#: (number, topic, document, page hint, quotation, grade, warnings)
CASES = [
    (1, "plain", "D1", 1, "pay 50% of fees", "exact", ()),
    (2, "changed", "D1", 1, "pay 25% of fees", "UNVERIFIED", ()),
    (3, "swapped", "D2", 1, "deliver in 60 days, pay in 30 days", "UNVERIFIED", ()),
    (4, "cut", "D1", 1, "costs $1", "UNVERIFIED", ()),
    (5, "cut", "D1", 1, "500 a year", "UNVERIFIED", ()),
    (6, "cut", "D1", 1, "rate is 1", "UNVERIFIED", ()),
    (7, "cut", "D2", 1, "due in 30", "exact", ()),
    (8, "negation", "D3", 1, "party may assign", "UNVERIFIED", ()),
    (9, "negation", "D4", 1, "A written notice is not needed", "UNVERIFIED", ()),
    (10, "negation", "D3", 1, "exceed the cap", "UNVERIFIED", ()),
    (11, "negation", "D3", 1, "A party may", "UNVERIFIED", ()),
    (12, "negation", "D3", 1, "takes more than ten days", "UNVERIFIED", ()),
    (13, "boundary", "D12", 1, "not", "UNVERIFIED", ()),
    (14, "boundary", "D4", 1, "is not needed", "exact", ()),
    (15, "stitched", "D5", 1, "First rule... Second rule.", "UNVERIFIED", ()),
    (16, "elided", "D5", 1, "either party ... may end it", "elided", ()),
    (17, "elided", "D5", 1, "either side ... end it", "UNVERIFIED", ()),
    (18, "elided", "D11", 1, "a ... b", "UNVERIFIED", ()),
    (19, "harmless", "D6", 1, "text across lines", "exact", ()),
    (20, "harmless", "D6", 1, "\"curly\" and 'single' marks".replace("'", "’"), "exact", ()),
    (21, "harmless", "D6", 1, "final office", "exact", ()),
    (22, "harmless", "D7", 1, "liability is capped by law", "exact", ()),
    (23, "harmless", "D7", 1, "termination date", "exact", ()),
    (24, "harmless", "D7", 1, "section 12.1 applies", "exact", ()),
    (25, "harmless", "D7", 1, "takes 11⁄2 days", "UNVERIFIED", ()),
    (26, "spanning", "D8", 1, "begins right here and then goes on over the page", "spanning", ()),
    (27, "fuzzy", "D9", 1, _SLIP, "fuzzy", ("not word for word",)),
    (28, "fuzzy", "D9", 1, _SLIP.replace("14", "15"), "UNVERIFIED", ()),
    (29, "ambiguous", "D8", 2, "passage repeats", "exact", ("appears more than once",)),
    (30, "page", "D8", 2, "this third page mentions", "exact", ("wrong page",)),
    (31, "blank", "D1", 1, "  ", "UNVERIFIED", ()),
    (32, "blank", "D404", 1, "pay 50% of fees", "UNVERIFIED", ()),
    (33, "scan", "D10", 1, "read from a scanned page", "exact", ("from a scan",)),
]

#: (answer, claim, sentence)
CLAIMS = [("a1", "c1", "Half is paid."), ("a2", "c1", "A quarter is paid."), ("a3", "c1", "Half is paid."), ("a3", "c2", "Nobody says so."), ("a4", "c1", "Half is paid.")]
