"""Surrogates: none of the originals stay, one entity one surrogate, formats kept, distinct."""

import hashlib
import random

import pytest
import regex as re

from gaugeworks.llm import pii

TEXT = "Dr. Smith met Mr. John Miller and Mrs Jane Miller, Mr. John Miller again; call +1 (555) 123-4567 or +1 555 123 4567, card 4111 1111 1111 1111 or 4111111111111111, ssn 123-45-6789, a.B@x.org A.b@X.org 10.0.0.1 DE89 3704 0044 0532 0130 00 Госпожа Иванова."
PLAIN = "version 2.0. costs 1,234.56 on 2024-01-02 in room 101; hex 0123abcd"


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_formats(spark, documents):
    r = pii.pseudonymize(documents([TEXT, PLAIN, None, ""]), "k", "found").collect()
    found = {x.doc_id: x for x in r}
    out = found[0].text
    assert found[0].found == 14 and found[1].text == PLAIN and found[2].text is None and found[3].text == ""
    for old in ("Smith", "John", "Miller", "Jane", "555", "4111", "123-45-6789", "x.org", "10.0.0.1", "3704", "Иванова"):
        assert old not in out.replace("Mrs Jane", "") or old == "555"
    m = re.fullmatch(
        r"Dr\. (\w+) met Mr\. (\w+ [\w-]+) and Mrs (\w+ [\w-]+), Mr\. (\w+ [\w-]+) again; call \+(\d) \((\d{3})\) (\d{3})-(\d{4}) or \+(\d) (\d{3}) (\d{3}) (\d{4}), card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), ssn (\d{3}-\d\d-\d{4}), (\S+@\S+\.example) (\S+@\S+\.example) "
        r"(\d+\.\d+\.\d+\.\d+) (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) Госпожа ([\u0400-\u04ff-]+)\.", out,
    )
    assert m and m[2] == m[4] and m[2].split()[0] in pii.GIVEN["m_latin"] and m[3].split()[0] in pii.GIVEN["f_latin"]
    assert m.group(5, 6, 7, 8) == m.group(9, 10, 11, 12) and m[13].replace(" ", "") == m[14] and luhn(m[14]) and m[16] == m[17]


def test_distinct_and_together(spark, documents):
    texts = [f"write to user{i % 700}@mail.example.com or 10.1.{i % 256}.{i % 7} and Mr. Adam Name{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(2000)]
    first = {r.doc_id: r.text for r in pii.pseudonymize(documents(texts), "k").collect()}
    again = {r.doc_id: r.text for r in pii.pseudonymize(documents(texts).repartition(7), "k").collect()}
    other = {r.doc_id: r.text for r in pii.pseudonymize(documents(texts[:5]), "another key").collect()}
    assert first == again and other[0] != first[0]
    for pattern in (r"\S+@\S+", r"\d+\.\d+\.\d+\.\d+", r"Mr\. .*"):
        forward, back = {}, {}
        for i, t in enumerate(texts):
            old, new = re.search(pattern, t)[0], re.search(pattern, first[i])[0]
            assert forward.setdefault(old, new) == new and back.setdefault(new, old) == old and old != new


def test_edge_cases(spark, edge):
    out = pii.pseudonymize(edge, "k")
    assert out.columns == edge.columns and sorted(map(str, out.collect())) == sorted(map(str, edge.collect()))
    assert pii.pseudonymize(edge.limit(0), "k").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain(texts, key):
    """The whole operator in plain Python: each text with its replacements, and the number of mentions."""
    every = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in pii.PATTERNS))
    titles = {t: g for g, ts in pii.TITLES.items() for t in ts}
    listed = {f"latin_{n.lower()}": g for g, ns in pii.GIVEN_NAMES.items() for n in ns}
    title = re.compile(rf"^({pii._TITLE})\.?\x20")

    def script(name):
        return "cyrillic" if re.match(r"\p{Cyrillic}", name) else "greek" if re.match(r"\p{Greek}", name) else "latin"

    def parts(kind, mention):
        if kind != "person":
            plain = mention.lower() if kind == "email" else mention if kind == "ip" else mention.replace(" ", "") if kind == "iban" else re.sub("[^0-9+]", "", mention)
            return [(kind, plain, None, None)]
        m = title.match(mention)
        names = mention[m.end() if m else 0 :].split(" ")
        gender = titles[m[1]] if m else None
        return [("family" if i == len(names) - 1 else "given", f"{script(n)}_{n.lower()}", gender, n) for i, n in enumerate(names)]

    def kind_of(mention):
        # a mention's kind by its form alone, as it may come from several texts
        for kind, p in (("email", "@"), ("ip", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), ("iban", "^[A-Z]{2}[0-9]{2}"), ("card", r"^(?:[0-9]{4}[ -]){3}[0-9]{4}$|^[0-9]{13,19}$"), ("number", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("phone", r"^[+(0-9]")):
            if re.search(p, mention):
                return kind
        return "person"

    found = {t: [m[0] for m in every.finditer(t)] for t in texts}
    entities = {}
    for ms in found.values():
        for m in ms:
            for kind, entity, gender, _ in parts(kind_of(m), m):
                entities.setdefault((kind, entity), set()).add(gender)

    def drawn(kind, entity, draw):
        seed = hashlib.sha256("\x1f".join((key, kind, entity, str(draw))).encode()).hexdigest()
        decimal = (seed + seed[::-1]).translate(str.maketrans("abcdef", "246813"))
        letters = lambda x, n: x[:n].translate(str.maketrans("0123456789abcdef", "bcdfghjklmnprstv"))
        digits = re.sub("[^0-9]", "", entity)
        if kind in ("given", "family"):
            group, name = entity.split("_")[0], None
            said = entities[kind, entity]
            gender = "f" if "f" in said and "m" not in said else "m" if "m" in said and "f" not in said else listed.get(entity, "n")
            words = pii.FAMILY[group] if kind == "family" else pii.GIVEN[f"{gender}_{group}"]
            ends = pii.ENDINGS[f"family_{group}" if kind == "family" else f"{gender}_{group}"]
            pick = lambda at, xs: xs[int(seed[at : at + 4], 16) % len(xs)]
            name = pick(0, words) if draw < 2 else "".join(pick(4 + 4 * i, pii.SYLLABLES[group]) for i in range(draw)) + pick(0, ends)
            return f"{group}_{name.lower()}"
        if kind == "email":
            return letters(seed, 10) + "." + (seed[10:30] + seed[10:30][::-1]).translate(str.maketrans("abcdef", "246813"))[:4] + "@" + letters(seed[30:50], 8) + ".example"
        if kind == "ip":
            b = [int(seed[2 * i : 2 * i + 2], 16) for i in range(4)]
            return f"{b[0] % 223 + 1}.{b[1]}.{b[2]}.{b[3]}"
        if kind == "iban":
            n = [int(seed[(2 * i) % 62 : (2 * i) % 62 + 2], 16) + i for i in range(len(entity))]
            body = "".join(str(n[i] % 10) if c.isdigit() else chr(65 + n[i] % 26) for i, c in enumerate(entity[4:]))
            rest = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
            return f"{entity[:2]}{98 - rest:02}{body}"
        if kind == "card":
            body = entity[0] + decimal[: len(entity) - 2]
            return next(body + str(d) for d in range(10) if luhn(body + str(d)))
        if kind == "phone":
            m = re.match(rf"\+(?:{pii.COUNTRY})", entity)
            country = m[0] if m else ""
            return country + decimal[: len(digits) - max(len(country) - 1, 0)]
        return decimal[: len(digits)]

    draws = dict.fromkeys(entities, 0)
    while True:
        tried = {e: drawn(*e, draws[e]) for e in entities}
        by = {}
        for e, s in tried.items():
            by.setdefault((e[0], s), []).append((draws[e], e[1]))
        again = [(k[0], entity) for k, es in by.items() for draw, entity in es if k in entities or (draw, entity) != min(es)]
        if not again:
            break
        for e in again:
            draws[e] += 1

    def cased(word, s):
        s = s.split("_")[1]
        return s.upper() if word.upper() == word else s[0].upper() + s[1:]

    def said(m):
        kind = kind_of(m)
        mine = [(word, tried[k, e]) for k, e, _, word in parts(kind, m)]
        if kind == "person":
            head = title.match(m)
            return (head[0] if head else "") + " ".join(cased(*x) for x in mine)
        s = mine[0][1]
        if kind == "email":
            return s.upper() if m.upper() == m else s
        if kind == "ip" or len(re.sub("[^0-9A-Z+]", "", m)) != len(s):
            return s
        left = iter(s)
        return "".join(next(left) if re.match("[0-9A-Z+]", c) else c for c in m)

    out = []
    for t in texts:
        names = {(x[3], cased(x[3], tried["family", x[1]])) for m in found[t] if kind_of(m) == "person" for x in parts("person", m)[-1:]}
        text, at = "", 0
        for m in [*every.finditer(t), None]:
            gap = t[at : m.start() if m else len(t)]
            for old, new in sorted(names):
                gap = re.sub(rf"(?<![\p{{L}}\p{{M}}]){old}(?![\p{{L}}\p{{M}}])", new, gap)
            text += gap + (said(m[0]) if m else "")
            at = m.end() if m else at
        out.append((text, len(found[t])))
    return out


LINE = "Mr. Παππάς ... GB82 WEST 1234 5698 7654 32 ... +442071234567 ... Mr. John Miller met Mr. Miller. Carol Jones came. MILLER left; Miller's hat, Millers, Dr. McDonald, Mrs. O'Neil, Frau Anna-Lena Groß-Weiß."


def test_line(spark, documents):
    out = pii.pseudonymize(documents([LINE]), "k").first().text
    m = re.fullmatch(
        r"Mr\. (\p{Greek}+) \.\.\. (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) \.\.\. \+44(\d{10}) \.\.\. Mr\. (\w+) (\w+) met Mr\. (\w+)\. (\w+) (\w+) came\. MILLER left; (\w+)'s hat, Millers, Dr\. (\w+), Mrs\. (\w+), Frau (\w+) (\w+)\.", out,
    )
    assert m and m[5] == m[6] == m[9] != m[8] and m[4] in pii.GIVEN["m_latin"] and m[7] in pii.GIVEN["f_latin"] and m[12] in pii.GIVEN["f_latin"] and m[3] != "2071234567"
    code = m[2].replace(" ", "")
    assert code[4:8] != "WEST" and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def made_texts(seed, n=400):
    r = random.Random(seed)
    family = ["Miller", "Smith", "O'Neil", "McDonald", "Иванова", "Петров", "Παππάς", "Groß-Weiß", "Garcia"] + [f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    given = ["John", "Carol", "Anna-Lena", "Alex", "Ольга", "Νίκος", "Maria", "Zed"]
    letters = "ABCDEFGHIJ"

    def piece():
        return r.choice([
            lambda: f"{r.choice(['Mr.', 'Mrs', 'Dr.', 'Prof', 'Frau', 'Госпожа', 'Κύριος'])} {r.choice(family)}", lambda: f"{r.choice(['Mr', 'Ms.', 'Dr'])} {r.choice(given)} {r.choice(family)}", lambda: f"{r.choice(given)} {r.choice(family)}",
            lambda: r.choice(family), lambda: r.choice(family).upper() + "'s", lambda: f"Mr. {r.choice(family).upper()}", lambda: f"u{r.randrange(40)}@{r.choice(['a', 'B'])}.example.org", lambda: f"10.{r.randrange(300)}.0.{r.randrange(20)}",
            lambda: f"{r.choice(['GB', 'DE'])}{r.randrange(10, 99)} {''.join(r.choices(letters, k=4))} {r.randrange(1000, 9999)} {r.randrange(1000, 9999)} {r.randrange(10, 99)}", lambda: f"+{r.choice(['44', '1', '351', '7'])}{r.randrange(10**9, 10**10)}",
            lambda: f"({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}", lambda: f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", lambda: f"4{r.randrange(10**14, 10**15)}", lambda: " ".join(str(r.randrange(1000, 9999)) for _ in range(4)), lambda: "plain words, and 12 more.",
        ])()

    return ["; ".join(piece() for _ in range(r.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("many", [1024, 3])
def test_against_plain_python(spark, monkeypatch, many):
    monkeypatch.setattr(pii, "MANY", many)
    texts = [*made_texts(many), LINE, TEXT, PLAIN]
    frame = spark.createDataFrame([(i, t, 7, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, found long, mention string, key string").repartition(5)
    out = pii.pseudonymize(frame, "some key", "found")
    assert out.columns == ["doc_id", "text", "mention", "key", "found"]
    got = {r.doc_id: (r.text, r.found) for r in out.collect()}
    for i, want in enumerate(plain(texts, "some key")):
        assert got[i] == want, texts[i]


def test_null_ids_and_long_texts(spark):
    long = "x " * 600_000 + "Mr. Miller"
    rows = [(None, None), (None, None), (None, ""), (None, "Mr. Miller"), (None, "Mr. Miller"), (1, long)]
    found = sorted((r.text or "" for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()), key=len)
    assert len(found) == 6 and found[:3] == ["", "", ""] and found[3] == found[4] == found[5][-len(found[3]) :] != "Mr. Miller"
