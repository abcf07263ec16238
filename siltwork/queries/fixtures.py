"""Generated rows that both engines read alike: questions, rule tables, a question bank, gold rows and translations."""

from __future__ import annotations

import random

from .base import values

WORDS = ("fees", "loan", "limit", "animal", "farm", "tool", "grant", "audit", "list", "papers", "leave", "charge", "house", "school", "water", "of", "the", "new")
HEADS, STOPS, GENERIC = ("loan", "grant"), ("of", "the"), ("new",)
MANUALS = ("ma_2025", "mb_2025", "mc_2024")
CLAUSES = tuple(f"{a}.{b}" for a in range(1, 5) for b in range(1, 4))
TERMS = (("old charge", "service charge"), ("papers list", "document list"))
UNITS = ("month", "percent", "taka")
ROLES = ("area manager", "branch officer", "programme head", "team lead", "assistant area manager")
POSTS = {"area manager": "am", "AM": "am", "branch officer": "bo", "programme head": "ph", "team lead": "tl", "assistant area manager": "aam"}
_r = random.Random(20)


def _say(lo: int, hi: int) -> str:
    return " ".join(_r.choice(WORDS) for _ in range(_r.randint(lo, hi)))


def _topic() -> str:
    one = lambda: _r.choice(WORDS[:15])
    return ";".join(_r.choice((one(), f"{one()}+{one()}", f"{one()}|{one()}+{one()}")) for _ in range(_r.randint(0, 3)))


NAME_ROWS = [(f"n{i:02}", f"{a} {b} {k}", k, f"{a};{b}", _r.choice(("active", "suspended")), f"{a} {b} {k} is there.") for i, (a, b, k) in enumerate((("farm", "animal", "loan"), ("farm", "tool", "loan"), ("farm", "house", "loan"), ("farm", "water", "loan"), ("school", "new", "grant"), ("house", "water", "grant"), ("audit", "tool", "grant"), ("animal", "water", "loan")))]
NAMES = values("name_id name kind words status status_line", *NAME_ROWS)
_name = lambda: _r.choice(NAME_ROWS)[1]
ASKS = values("qid question clauses manual answer", *((i, (_say(1, 5) + " " + (_name() if i % 5 == 0 else "") + " " + _say(0, 2)).replace("  ", " ").strip(), ";".join(_r.sample(CLAUSES, _r.randint(1, 3))), _r.choice(MANUALS), "draft with old charge " + _say(1, 3)) for i in range(500)))
RULES = values("rule_id manual clause verdict topic_terms rule_summary current_rule", *((f"R{i:02}", _r.choice(("ma", "mb", "both", "mc_2024")), ";".join(_r.sample(CLAUSES, _r.randint(1, 3))), _r.choice(("changed", "retired", "not_confirmed", "confirmed")), _topic(), _say(2, 5), f"rule {i} says " + _say(1, 3)) for i in range(60)))
HELD = values("item manual clause topic_terms says reason", *((f"W{i:02}", _r.choice(("ma", "mb", "both")), ";".join(_r.sample(CLAUSES, _r.randint(1, 2))) if i % 3 else "", _topic(), f"not given out: {_say(2, 4)}", _name() if i % 2 else _say(1, 2)) for i in range(40)))
FREQUENCY = values("term df", *((w, _r.choice((0, 3, 20, 21, 400))) for w in WORDS[:12]))


def _figure() -> str:
    return f"{_r.choice((0, 5, 6, 10, 12, 18, 35, 60, 700))} {_r.choice(UNITS)}"


def _question(i: int) -> tuple:
    kind = _r.choice(("figure", "role"))
    pick = _figure if kind == "figure" else lambda: _r.choice(ROLES)
    correct = pick()
    options = [correct if _r.random() < 0.9 else pick()] + [pick() for _ in range(_r.choice((2, 3, 3, 3, 4)))]
    if kind == "role" and _r.random() < 0.2:
        options[-1] = "AM"
    seg = {"figure": _r.choice((f"the limit is {correct}.", f"from {correct} - 90 month in all", f"see {_figure()} and {correct}", "6 x 5 = 30 taka", _figure())), "role": _r.choice((f"the {correct} signs it", f"the {correct}s signs it", f"papers of {correct} is checked by others", f"sub{correct} signs it", f"{_r.choice(ROLES)} and {correct} sign"))}[kind]
    asks = _r.choice(("what is the limit?", "who signs it?", f"is {correct} right?", "", "the manager of the area signs?"))
    text = f"{seg} and also {_figure()} with {pick()}" if _r.random() < 0.8 else "another text"
    return (i, kind, asks, correct, ";".join(options), seg, text, f"c{_r.randint(0, 80)}", _r.choice(CLAUSES), ";".join(_r.sample(("p1", "p2", "p3", "p4"), _r.randint(1, 2))), _r.choice(("fees", "worked example", "limits", "farm loan")), _r.random() < 0.1)


BANK = values("id kind question correct options explanation chunk_text chunk_id clause products heading excluded", *(_question(i) for i in range(500)))
TRUTHS = values("id rule_id statement", *((_r.randint(0, 499), f"T{i}", f"now {_figure()} or the {_r.choice(ROLES)}") for i in range(200)))
POOL = values("span chunk_id clause products", *((_figure(), f"c{_r.randint(0, 80)}", _r.choice(CLAUSES), _r.choice(("p1", "p2", "p3", "p4", "p5", "p1;p5"))) for _ in range(40)))
GOLD = values("id scope mode cites armed answerable", *((i, _r.choice(("ma", "mb_2025", "any", "both", "m", "mc_2024")), _r.choice(("all", "any")), ";".join(_r.choices(("ma_2025", "mb_2025", "mc_2024", "md_2023"), k=_r.randint(0, 3))), _r.randint(0, 2), _r.random() < 0.7) for i in range(300)))
INSURERS = ("Guard Life Insurance PLC", "Delta Insurance Limited")
GLOSSES = (("Boro Loan", "big loan"),)
AGREED = (("কিস্তি", "instalment", "installment"), ("ঋণ", "loan", "credit"))


def _pair(i: int) -> tuple:
    n = [str(_r.choice((5, 12, 18, 40))) for _ in range(_r.randint(1, 3))]
    bn = "".join(f"{x.translate(str.maketrans('0123456789', '০১২৩৪৫৬৭৮৯')) if _r.random() < 0.5 else x} {_r.choice(('মাস', 'কিস্তি', 'ঋণ'))} " for x in n)
    en = [x if _r.random() < 0.8 else "7" for x in n]
    tail = _r.choice(("", "Guard Life Insurance PLC", "Guard Life Insurance Limited", "Delta Company Ltd", "Delta Insurance Limited"))
    gloss = _r.choice(("", "Boro Loan (big loan)", "Boro Loan here"))
    return (i, bn.strip(), f"{' '.join(x + ' ' + _r.choice(('months', 'instalment', 'installment', 'loan', 'credit')) for x in en)} {tail} {gloss}".strip())


PAIRS = values("id bn en", *(_pair(i) for i in range(300)))

_r = random.Random(21)
_FACT = ("the fee is 5 taka", "12 month at most", "audit first", "the list is open")
FACTS = values("qid n kind text ref verified", *((q, n, _r.choice(("literal", "literal", "claim", "absent")), _r.choice(_FACT), _r.choice((None, *(f"c{k}" for k in range(9)))), _r.choice(("render", "source"))) for q in range(80) for n in range(_r.randint(1, 5))))
REPLIES = values("qid answer", *((q, " and ".join(_r.sample(_FACT, _r.randint(0, 3)))) for q in range(76)))
CONTEXT = values("qid chunk_id", *((q, f"c{k}") for q in range(70) for k in _r.sample(range(9), _r.randint(1, 5))))
GROUPS = values("chunk_id dup_group", ("c0", "g1"), ("c1", "g1"), ("c2", "g2"), ("c3", "g2"), ("c4", "g2"))
CITED = values("run qid ok achievable", *((run, q, _r.choice((True, True, False, False, None)), _r.choice((True, False, None))) for run in "ab" for q in range(200) if _r.random() < 0.9))
