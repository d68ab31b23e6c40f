"""p7: held-out accuracy on patterns that training doesn't know, exact spans, skip edges, edge cases."""

import numpy as np

from ledgerloom.llm.pii import Batch, Tagger, Words, agree, find_pii, parts, redact, skip_key, train
from ledgerloom.llm.pii_seeds import OTHERS, PATTERNS, Maker

#: Patterns that occur in no training text.
NEW = """The watch that {name} left at the bakery is with us now.
Tonight {name} and {name} sing at the town hall.
Who knows where {name} has gone?
The prize goes to {name}, who wrote the best essay.
Leave a word for me at {phone} or drop a line: {email}.
Ring {phone} and let it ring long.
Their shed stands at {address}, behind a wall.
Ship both crates to {address}.
He typed {label} {id} twice.
Under {label} {id} nothing was found.
Gestern hat {name} das Fahrrad abgeholt.
Hier {name} est partie en vacances.
कल {hname} ने पौधे लगाए।""".split("\n")
PLAIN = """The harvest was poor this year and the barns stayed empty.
Orders from {company} doubled in spring.
We owe {amount} to {company} since {date}.
Meter {number} was read on {date}.
Grapes and Olives are sold on Market Day.
The Museum of Natural History opens at ten.
La moisson fut bonne et les granges sont pleines.
फसल अच्छी हुई और सब खुश थे।""".split("\n")


def test_held_out():
    seen = {p.strip() for t in (PATTERNS, OTHERS) for p in t.split("\n")}
    assert not seen & set(NEW + PLAIN)
    rng = np.random.default_rng(99)
    maker, tagger, hit, made, found = Maker(rng), Tagger(train()), 0, 0, 0
    for _ in range(150):
        text, want = "", set()
        maker.people = []
        for k in range(4):
            for piece, kind in maker.fill(maker.pick(PLAIN if k % 2 else NEW)):
                if kind:
                    want.add((piece, kind))
                text += piece
            text += "\n"
        got = {(text[a:b], k) for a, b, k in tagger.documents([text])[0]}
        hit, made, found = hit + len(got & want), made + len(want), found + len(got)
    assert hit / made > 0.85 and hit / found > 0.85, (hit / made, hit / found)


def test_spans_and_redaction(spark):
    text = "Please contact Ms. Orlina Vestrup on +91 57203 03741 for help.\nWrite to a.b@post.example.net within the week. The cheque from Vestrup Traders was returned."
    df = spark.createDataFrame([(1, text, "n"), (2, None, "n"), (3, "", "n"), (4, "No one was at home.", "n"), (None, text, "n"), (5, text + ("\nNo one was at home." * 5000), "n")], "doc_id long, text string, found string")
    got = {r.id: r for r in find_pii(df).collect()}
    assert sorted(got) == [1, 5]
    assert {(x.pii_type, x.pii_text) for x in got[1].found} == {("name", "Orlina Vestrup"), ("phone", "+91 57203 03741"), ("email", "a.b@post.example.net")}
    assert "contact Ms. [NAME] on [PHONE] for help" in got[1].redacted and "Vestrup Traders" in got[1].redacted
    assert all(text[x.start : x.end] == x.pii_text for x in got[1].found)
    assert find_pii(df.limit(0)).count() == 0


def test_skip_edges_find_what_the_chain_alone_does_not():
    """A name in a line that says nothing of persons is found through its mention elsewhere in the document, and only so."""
    tagger = Tagger(train())
    assert skip_key("Zavellin’s") == "zavellin" == skip_key("ZAVELLIN") and skip_key("12ab") is None and skip_key("the") is None and skip_key("Rao") == "rao"
    rng = np.random.default_rng(5)
    maker, only = Maker(rng), 0
    for _ in range(200):
        first, last = maker.word(), maker.word()
        head = f"Dear Mr. {first} {last},\nThe account holder {first} {last} signed.\nContact person: {first} {last}\n"
        text = head + f"Yesterday evening {first} {last} then"
        spans = lambda: {(a, k) for a, _, k in tagger.documents([text])[0] if a > len(head)}
        kept = tagger.model.skip.copy()
        with_edges = spans()
        tagger.model.skip[:] = 0
        only += ("name" in {k for _, k in with_edges}) and not spans()
        tagger.model.skip[:] = kept
    assert only >= 3, only


def test_messages_settle_and_sure_words_send_them():
    model = train()
    words = Words(model.weights)
    batch = Batch(words, ["Dear Mr. Vestor Amblin,\nVestor Amblin"])
    emit = batch.emissions(words)
    gamma, (left, right) = agree(model, batch, emit)
    assert len(left) == len(right) == 2 and np.allclose(gamma.sum(axis=1), 1)
    again, _ = agree(model, batch, emit, tolerance=1e-9, rounds=500)
    assert np.abs(gamma - again).max() < 0.01


def test_overlaps_and_tokens():
    assert redact("abcdef", [(0, 4, "name"), (2, 6, "phone")]) == "[NAME]ef"
    assert parts("<a@b.c>,") == ("<", "a@b.c", ">,") and parts("(x)") == ("(", "x", ")") and parts("--") == ("--", "", "")


def test_very_long_line():
    tagger = Tagger(train())
    text = "the road was long and nobody spoke " * 8000 + "Contact person: Orlina Vestrup"
    assert [text[a:b] for a, b, _ in tagger.documents([text])[0]] == ["Orlina Vestrup"]
