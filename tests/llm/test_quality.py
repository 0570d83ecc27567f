import re

from paperloom.llm import quality
from tests.llm.data import docs, no_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_base_counts_equal_brute_force(spark):
    texts = [prose(1, 300), "a b c d e a b c d e f", "x y z w v " * 12, "line one here\nline one here\n\n\nline one here", "##| <a> & 100%\n" * 3, "a\x1cb c\x85d e\xa0f", "tab\tvt\x0bff\x0ccr\rend"]
    df = docs(spark).where("doc_id <> 7").unionByName(docs(spark, texts, first=50))
    for r in quality.judged(df, with_text=False).select("text", "verdict.*").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(r["text"])
        assert not (r["base_failed"] and r["kept"])


def test_lines_are_judged_alone():
    good = prose(4, 40)
    bad = ["home | about | news | contact | login", "All rights reserved.", "We use cookies.", "menu", "buy%%% now%%% this%%% fine%%% thing%%%"]
    kept = quality.judge(good + "\n" + "\n".join(bad) + "\n" + good)
    assert kept[6] is False and kept[7] == len(bad)  # the text repeats itself, so the base rule fails
    kept = quality.judge(good + "\n" + "\n".join(bad))
    assert kept[6] and kept[7] == len(bad) and kept[8] == good
    lost = quality.judge("\n".join([" | ".join(prose(i, 12).split()) for i in range(9)]))
    assert not lost[6] and not lost[5]


NOTICES = {
    "en": ["© 2024 Example Ltd.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Read our privacy policy and the terms of use here.", "Please log in to continue."],
    "de": ["Alle Rechte vorbehalten.", "Lizenziert unter der MIT-Lizenz.", "Mehr dazu in unserer Datenschutzerklärung.", "Diese Seite verwendet Cookies.", "Jetzt anmelden und weiterlesen!"],
    "fr": ["Tous droits réservés.", "Publié sous licence MIT.", "Voir notre politique de confidentialité.", "Ce site utilise des cookies.", "Abonnez-vous dès maintenant !"],
    "es": ["Todos los derechos reservados.", "Publicado bajo la licencia MIT.", "Consulte nuestra política de privacidad.", "Este sitio utiliza cookies.", "Suscríbete hoy mismo."],
}
CLEAN = {
    "en": ["The river rose by a metre in one night.", "She logged the results and went home.", "Every right has its price.", "\"Who is there?\" he asked.", "They baked bread for the whole street."],
    "de": ["Der Fluss stieg über Nacht um einen Meter.", "Sie hatte recht behalten.", "Die Bedingungen waren hart.", "Er las den Brief zweimal.", "Am Abend wurde es kalt."],
    "fr": ["La rivière a monté d'un mètre cette nuit.", "Il avait le droit de partir.", "Nous avons lu la lettre deux fois.", "Le pain était encore chaud.", "Où vas-tu ?"],
    "es": ["El río subió un metro en una noche.", "Tenía derecho a irse.", "Leímos la carta dos veces.", "El pan estaba todavía caliente.", "¿Adónde vas?"],
}


def test_notices_of_all_four_languages_are_found():
    fails = lambda line: quality.line_fails(line, line.encode().split())
    for lang in NOTICES:
        assert sum(map(fails, NOTICES[lang])) == 5, lang
        assert not [x for x in CLEAN[lang] if fails(x)], lang
    assert not fails("هل هذا صحيح؟") and not fails("यह सही है।")


#: Lines of plain prose that hold the words of notices, and notices; made by hand.
PROSE = """She wrote a blog in French for ten years before the war.
A catalog in the library lists every book by its author.
An analog in nature is the spiral of a shell.
Mix the cookie dough and bake it for ten minutes.
The mill was powered by a wheel in the stream.
The prisoner was released under a deal with the court.
He was licensed under state law to sell wine.
They threw the last log in the stove and waited.
He would not subscribe to that opinion, nor to any other.
Nobody would sign up to row against the wind.
It clicks; here comes the train at last.
The right to vote was reserved for a few in 1848.
In common, creative people sleep badly.
We ate three cookies and drank all of the milk.
The policy of privacy in that house was silence.
Der Keks lag unter dem Schrank, klick machte das Schloss.
Sie war jetzt angemeldet und wartete im Flur.
Die Lizenz hing unter Glas an der Wand.
Il avait la licence sous le bras en sortant.
Les conditions de la paix furent dures pour tous.
Nous avons cliqué et rien ne s'est passé.
El aviso llegó tarde y era poco legal.
La policía de la ciudad cerró la calle.
Bajo la mesa dormía un perro viejo.""".split("\n")
MORE_NOTICES = """Powered by WordPress
Proudly powered by Example CMS.
Log in | Register | Help with this
This site uses cookies to improve your visit.
Please log in to comment on this page.
Copyright (c) 2020 The Authors. Ask before you copy.
By using this site you accept our Terms of Service.
Released under the MIT License.
This work is licensed under the GNU General Public License, version 3.
Sign up for our mailing list today.
Veröffentlicht unter der GNU General Public License oder einer freien Lizenz.
Klicken Sie hier, um mehr zu erfahren.
POLITIQUE DE CONFIDENTIALITÉ.
Haga clic aquí para leer el texto completo.
Inscrivez-vous et lisez la suite.""".split("\n")


def test_prose_with_the_words_of_notices_stays():
    fails = lambda line: quality.line_fails(line, line.encode().split())
    assert not [x for x in PROSE if fails(x)]
    assert sum(map(fails, MORE_NOTICES)) >= 0.9 * len(MORE_NOTICES)


def test_clean_documents_stay_and_columns_too(spark):
    df = docs(spark, [prose(i, 50 + 7 * i) for i in range(20)] + [None, "", "too short"])
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    assert quality.filter_documents(no_docs(spark)).count() == 0
