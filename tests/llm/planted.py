"""Texts with planted personal data and secrets that the base patterns miss, with look-alikes, and where the planted ones are."""

import random

GIVEN = "Michael Laura Peter Anna Carlos Sophie Thomas Julia David Emma".split()
FAMILY = "Brown Keller Moreau Lindqvist Okafor Tanaka Novak Silva Hughes Adler".split()
PLACES = ["Victoria Station", "Martin Street", "Charlotte Avenue", "Rosa Park", "Jackson City", "Adrian Hill Road", "Diana Museum"]
#: Words that speak for personal data, but stand anywhere in these texts.
CUES = "call mail account name mobile card".split()


def filler(r, n, cues=0.0):
    return [r.choice(CUES) if r.random() < cues else "".join(r.choice("aeioustrnlmd") for _ in range(r.randrange(2, 9))) for _ in range(n)]


def digits(r, n):
    return "".join(r.choice("0123456789") for _ in range(n))


def account(r):
    body = digits(r, 18)
    check = 98 - int(body + "131400") % 97  # D and E as numbers, then 00
    return "DE" + f"{check:02d}" + body


def personal(r):
    """(kind, words before, text) of something personal that no base pattern finds."""
    kind = r.choice(["number", "email", "name", "account"])
    if kind == "number":
        three, four = f"{r.randrange(200, 999)}", f"{r.randrange(1000, 9999)}"
        text = r.choice([f"{r.randrange(200, 999)}-{three}-{four}", f"({r.randrange(200, 999)}) {three}-{four}", f"0{r.randrange(150, 180)} {three} {four}"])
        return kind, r.choice([["phone"], ["tel"], [], ["call", "me"]]), text
    if kind == "account":
        return kind, r.choice([["iban"], ["account"], []]), account(r)
    if kind == "email":
        user = f"{r.choice(GIVEN).lower()}.{r.choice(FAMILY).lower()}"
        text = r.choice([f"{user} [at] {r.choice(['gmail', 'firma', 'web'])} [dot] {r.choice(['com', 'de', 'org'])}", f"{user}(at){r.choice(['gmail', 'posteo'])}.de", f"{user} at {r.choice(['outlook', 'yahoo', 'ville'])} dot {r.choice(['com', 'fr'])}"])
        return kind, r.choice([["email"], ["contact"], []]), text
    return kind, r.choice([["Dr"], ["Mrs"], ["signed"], ["Herr"], []]), f"{r.choice(GIVEN)} {r.choice(FAMILY)}"


def impersonal(r):
    """Words before, and a text that looks alike and is nobody's."""
    return r.choice([
        lambda: (["order"], f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)}"), lambda: (["page"], digits(r, 7)), lambda: ([], f"2{digits(r, 7)}"), lambda: ([], f"20{r.randrange(10, 25)}-0{r.randrange(1, 9)}-1{r.randrange(9)} 12{r.randrange(10, 59)}"),
        lambda: (["isbn"], f"978-3-{digits(r, 2)}-{digits(r, 6)}-{digits(r, 1)}"), lambda: (["model"], digits(r, 9)), lambda: ([], digits(r, 16)), lambda: (["looked"], f"{''.join(filler(r, 1))} at {''.join(filler(r, 1))}.{''.join(filler(r, 1))}"), lambda: ([], f"@{''.join(filler(r, 1))}"),
        lambda: ([], r.choice(PLACES)), lambda: (["name"], "The Monday Group"),
    ])()


def texts(seed, n, cues=0.05):
    """n texts, and of each the planted (kind, start, end)."""
    r, out, where = random.Random(seed), [], []
    for _ in range(n):
        words, spans = filler(r, r.randrange(5, 40), cues), []
        for _ in range(r.randrange(0, 3)):
            real = r.random() < 0.4
            kind, before, text = personal(r) if real else ("", *impersonal(r))
            words += before
            start = len(" ".join([*words, ""]))
            words.append(text)
            if real:
                spans.append((kind, start, start + len(text)))
            words += filler(r, r.randrange(8, 30), cues)
        out.append(" ".join(words))
        where.append(spans)
    return out, where


def scored(found, where):
    """Precision and recall of spans (kind, start, end) of each text: right if one overlaps a planted span by half of both."""
    def same(a, b):
        shared = min(a[2], b[2]) - max(a[1], b[1])
        return 2 * shared >= max(a[2] - a[1], b[2] - b[1])

    right = sum(any(same(f, w) for w in ws) for fs, ws in zip(found, where, strict=True) for f in fs)
    hit = sum(any(same(f, w) for f in fs) for fs, ws in zip(found, where, strict=True) for w in ws)
    return right / max(1, sum(map(len, found))), hit / max(1, sum(map(len, where)))


BASE62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def drawn(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n - 2)) + r.choice("0123456789") + r.choice(alphabet)


def secret(r):
    """What goes before a secret that no base pattern finds, the secret, and what follows."""
    return r.choice([
        lambda: ('pwd = "', drawn(r, BASE62, r.randrange(16, 32)), '"'), lambda: ("PRIVATE: ", drawn(r, BASE62 + "+/", 40), ""), lambda: ("Authorization: Bearer ", drawn(r, BASE62 + "-_", r.randrange(40, 80)), ""), lambda: ("", "ghp_" + drawn(r, BASE62, 36), ""),
        lambda: ("charge with ", "sk_live_" + drawn(r, BASE62, 24), ""), lambda: ("signature ", drawn(r, "0123456789ABCDEF", 40), ""), lambda: ("my secret is ", drawn(r, BASE62, 24), ""), lambda: ("passphrase -> ", drawn(r, BASE62 + "-_", 28), ""),
    ])()


def no_secret(r):
    """Something long that is no secret."""
    word = lambda: "".join(filler(r, 1))
    return r.choice([
        lambda: "get" + "".join(word().title() for _ in range(4)), lambda: "_".join(filler(r, 4)), lambda: f"http://{word()}.net/{word()}/{word()}?{word()}={r.randrange(99)}", lambda: f"C:/{word()}/{word()}/{word()}.docx", lambda: "".join(filler(r, 4)), lambda: "-".join(filler(r, 4)),
        lambda: f"{word()}-{r.randrange(9)}.{r.randrange(20)}.{r.randrange(20)}.tar.gz", lambda: f"20{r.randrange(10, 25)}-0{r.randrange(1, 9)}-1{r.randrange(9)}T12:{r.randrange(10, 59)}:31+02:00", lambda: f"+4{r.randrange(9)} ({digits(r, 3)}) {digits(r, 3)}-{digits(r, 4)}", lambda: "_".join(filler(r, 4)).upper(),
        lambda: "internationalisation", lambda: "Donaudampfschifffahrtsgesellschaft", lambda: f"the password of {word()} {word()}", lambda: f"{word()}.{word()}@{word()}.com", lambda: digits(r, 13),
    ])()


def secret_texts(seed, n):
    """n texts, and of each the planted ("secret", start, end)."""
    r, out, where = random.Random(seed), [], []
    for _ in range(n):
        text, spans = " ".join(filler(r, r.randrange(5, 40))), []
        for _ in range(r.randrange(0, 4)):
            text += " "
            if r.random() < 0.3:
                before, hidden, after = secret(r)
                spans.append(("secret", len(text + before), len(text + before + hidden)))
                text += before + hidden + after
            else:
                text += no_secret(r)
            text += " " + " ".join(filler(r, r.randrange(8, 30)))
        out.append(text)
        where.append(spans)
    return out, where
