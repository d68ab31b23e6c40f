"""p1: held-out accuracy, switches inside a sentence, what transitions do, mixed lines, labels, edge cases."""

import numpy as np
import pytest

from ledgerloom.llm import language
from ledgerloom.llm.language import Labeller, decide, label_code, label_segments, label_texts, train


@pytest.mark.parametrize("label,code", [("en_GB", "en"), ("हिन्दी", "hi"), ("fra", "fr"), ("German", "de"), ("hi-IN", "hi"), ("und", None), (" ", None), (None, None), ("n/a", None), ("xx", None)])
def test_labels(label, code):
    assert label_code(label) == code


HELD_OUT = {
    "en": "The officer told us that the papers were lost and nobody could find them.", "fr": "Elle nous a dit que les papiers étaient perdus depuis hier.",
    "de": "Der Beamte sagte uns, dass die Papiere verloren gegangen sind.", "hi": "अधिकारी ने कहा कि कागज़ खो गए हैं और किसी को नहीं मिले।",
    "mr": "अधिकाऱ्याने सांगितले की कागद हरवले आहेत आणि ते सापडले नाहीत.", "ne": "अधिकारीले भने कि कागज हराएको छ र कसैले भेटेको छैन।",
    "gu": "અધિકારીએ કહ્યું કે કાગળો ખોવાઈ ગયા છે.", "ta": "ஆவணங்கள் தொலைந்துவிட்டன என்று அதிகாரி கூறினார்.",
}


def test_held_out_sentences():
    lab = Labeller(train())
    for lang, s in HELD_OUT.items():
        assert decide(lab.lines([s])[0])[0][:2] == (-1, lang), lang
    romanised = "Adhikari ne kaha ki kagaz kho gaye hain aur kisi ko nahi mile."
    assert decide(lab.lines([romanised])[0])[0][1] == "hi"


def test_mixed_lines_and_names():
    lab = Labeller(train())
    got = decide(lab.lines([f"{HELD_OUT['hi']} They will mend the roof soon.\n\n{HELD_OUT['fr']}\nOrlan Pipes (India) 123"])[0])
    assert [(n, x) for n, x, _ in got] == [(0, "hi"), (0, "en"), (2, "fr")] or sorted((n, x) for n, x, _ in got) == [(0, "en"), (0, "hi"), (2, "fr")]
    assert [x[:2] for x in decide(lab.lines([HELD_OUT["de"] + "\nZürich–Genève £ 40 ½"])[0])] == [(-1, "de")]


def test_switch_inside_a_sentence():
    lab = Labeller(train())
    line = "Please tell my brother that kal subah hum log bazar nahi ja sakte hain"
    got = [(line[a:b], x) for a, b, x, _ in lab.segments(line)]
    assert [x for _, x in got] == ["en", "hi"] and got[0][0].startswith("Please tell my brother") and got[1][0].endswith("bazar nahi ja sakte hain")
    # one line, several sentences, a chain that switches between them
    line = f"{HELD_OUT['fr']} {HELD_OUT['en']} {HELD_OUT['mr']}"
    assert [x for _, _, x, _ in lab.segments(line)] == ["fr", "en", "mr"]


def test_transitions_count():
    """A word that could be of two languages goes with its neighbours, by the learned transitions."""
    model = train()
    assert all(model.trans[i, i] == model.trans[i].max() for i in range(len(language.LANGUAGES)))
    assert (np.diag(model.trans) - model.trans.mean(axis=1) > np.diag(model.across) - model.across.mean(axis=1)).all()
    lab = Labeller(model)
    gamma, _, _ = lab.chains([lab._part("plus tard ils sont venus")[0], lab._part("a plus for all of us")[0]], [1, 1])
    assert language.LANGUAGES[gamma[0].argmax()] == "fr" and language.LANGUAGES[gamma[6].argmax()] == "en"


def test_segments_query(spark):
    rows = [(1, None, 0), (2, " ", 0), (3, HELD_OUT["en"] + "\n" + HELD_OUT["de"], 0), (None, HELD_OUT["en"], 0), (4, "12 34", 0)]
    got = sorted((r.id, r.line_no, r.lang) for r in label_segments(spark.createDataFrame(rows, "doc_id long, text string, lang int")).collect())
    assert got == [(3, 0, "en"), (3, 1, "de")]


def test_edge_cases(spark):
    long = HELD_OUT["en"] + " "
    rows = [(1, None, None, 0), (2, "  ", "en", 0), (3, "", None, 0), (4, long * 3000, "hi", 0), (4, long * 3000, "hi", 0), (None, long, None, 0), (5, "12345", None, 0), (6, "à¤…à¤§à¤¿à¤•à¤¾à¤°à¥€ à¤¨à¥‡ à¤•à¤¹à¤¾ à¤•à¤¿ à¤•à¤¾à¤—à¤œà¤¼ à¤¹à¥ˆà¤‚", None, 0)]
    df = spark.createDataFrame(rows, "i long, text string, lang string, line_no int")
    got = sorted((x.id, x.line_no, x.lang) for x in label_texts(df, "i", "text", "lang").collect())
    assert got == [(4, -1, "en"), (4, -1, "en"), (6, -1, "hi")]
    assert label_texts(df.limit(0), "i", "text", "lang").count() == 0
    assert language.LANGUAGES[0] == "en"
