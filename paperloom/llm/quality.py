"""Quality rules, line first: bad lines are removed, then documents that lost too much text are rejected.

Each line that holds a word is judged on its own:

* punctuation: fewer than ``short_line`` words and no sentence end, or more than ``noisy_share`` of its
  words carry symbol punctuation (two or more of ``#*$%&|<>`` or ``!``);
* navigation: more than ``separator_share`` of its words are bare separators such as ``|`` or ``»``;
* boilerplate: at most ``boilerplate_words`` words and a licence, cookie, account or rights notice, by whole
  phrases of the four languages of the corpus, or by shorter ones that open the line (other languages
  are caught by the year after ``©`` alone).

A document is kept if it passes the base rules (``min_words``, share of words in repeated 5-word
windows) and its remaining lines hold at least ``keep_share`` of its word characters.

Null and empty texts have no words, fail the base rule and are rejected. Every rule reads the whole
text. Extra columns stay as they are; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import unused

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SENTENCE_END = re.compile(r"[.!?…。！？:;؟।॥։።][\"'”’»)\]]*$")
NOISY_WORD = re.compile(r"[#*$%&|<>]{2,}|!{2,}")
SEPARATORS = frozenset({b"|", b"||", b"/", b"//", b">", b">>", "»".encode(), "›".encode(), "•".encode(), "·".encode(), b"::"})
#: Licence, rights, cookie and account notices in English, German, French and Spanish: whole phrases that prose hardly holds ...
PHRASES = (
    r"all rights reserved|licen[sc]ed under (the |an? )?([^ ]+ ){0,5}(licen[sc]e|[^ ]*[0-9]\.[0-9])|released under (the |an? )?([^ ]+ ){0,5}licen[sc]e"
    r"|creative commons|general public license|copyright (©|\(c\)|[0-9]{4})|privacy policy|terms (of (use|service)|and conditions)"
    r"|(uses?|using|accept|allow|verwendet|verwenden|nutzt|nutzen|utilise|utilisons|utiliza|utilizamos|usa|usamos|acepta(r|mos)?)( (all|our|des|les|de|las|los|alle))? cookies"
    r"|cookies? (policy|settings|consent|preferences|notice|banner|richtlinie|einstellungen)|pol(itique|ítica) (relative aux|de|des|en matière de) cookies"
    r"|subscribe to (our|this) (newsletter|channel|feed|mailing list|blog|podcast)|sign up (now|today|here|for (our|updates|free|a free|an account|the newsletter))"
    r"|(please|must|need to|have to) log ?in|log ?in to (continue|comment|reply|post|view|your account)|click here"
    r"|alle rechte vorbehalten|lizenziert unter|veröffentlicht unter der ([^ ]+ ){0,3}[^ ]*lizenz|datenschutzerklärung|nutzungsbedingungen"
    r"|newsletter abonnieren|jetzt (anmelden|registrieren|abonnieren)|hier klicken|klicken sie hier"
    r"|tous droits réservés|sous licence|politique de confidentialité|conditions (générales )?d['’]utilisation|mentions légales"
    r"|abonnez-vous (à (notre|la)|dès maintenant|gratuitement)|cliquez ici|propulsé par"
    r"|todos los derechos reservados|bajo (la |una )?licencia [^ ]+|política de privacidad|términos (de uso|y condiciones)|aviso legal"
    r"|suscr[ií]bete (a|hoy|ya|ahora)|ha(z|ga) clic (aquí|en)|iniciar sesión"
)
#: ... and shorter ones where they open the line.
OPENINGS = r"(proudly )?powered by|subscribe|sign up|log ?in|abonnez-vous|inscrivez-vous|suscr[ií]b(ete|ase)|reg[ií]str(ate|ese)"
_EDGE = r"[^\p{L}\p{N}_]"
#: Said in what Python and RE2 read alike: no \b, \w or \s.
NOTICE = rf"(?i)(^|{_EDGE})({PHRASES})($|{_EDGE})|^{_EDGE}*({OPENINGS})($|{_EDGE})|© ?[0-9]{{4}}"
BOILERPLATE = regex.compile(NOTICE)


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_percent: int = 20
    short_line: int = 5
    noisy_share: float = 0.3
    separator_share: float = 0.2
    boilerplate_words: int = 20
    keep_share: float = 0.5


RULES = Rules()
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, cleaned string"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + size - max(upto, i)
            upto = i + size
    return total


def line_fails(line: str, words: list[bytes], rules: Rules = RULES) -> bool:
    n = len(words)
    if n < rules.short_line and not SENTENCE_END.search(line.rstrip(SPACES)):
        return True
    if sum(w in SEPARATORS for w in words) > rules.separator_share * n:
        return True
    if NOISY_WORD.search(line):
        noisy = sum(1 for w in words if NOISY_WORD.search(w.decode()))
        if noisy > rules.noisy_share * n:
            return True
    return n <= rules.boilerplate_words and BOILERPLATE.search(line) is not None


def _word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in SPACES)


def judge(text: str | None, rules: Rules = RULES, with_text: bool = True) -> tuple:
    text = text or ""
    words = text.encode().split()
    chars = _word_chars(text)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup, good, removed = set(), 0, [], 0
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            good.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_fails(line, own, rules):
            removed += 1
        else:
            good.append(line)
    repeated = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeated > rules.repeat_percent * len(words)
    left = chars if not removed else sum(map(_word_chars, good))
    kept = not failed and left >= rules.keep_share * chars
    return len(words), chars, symbols, dup, repeated, failed, kept, removed, "\n".join(good) if with_text and removed else None


def judged(docs: DataFrame, text_col: str = "text", out: str = "verdict", rules: Rules = RULES, with_text: bool = True) -> DataFrame:
    """``docs`` with the struct ``out``: the counts, the verdict and, ``with_text``, the cleaned text where lines were removed."""
    names = [x.split()[0] for x in VERDICT.split(", ")]

    @F.pandas_udf(VERDICT)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(x, rules, with_text) for x in texts], columns=names)

    # Called nondeterministic so that a filter on the verdict is not moved below it, which would judge each text twice.
    return docs.withColumn(out, verdict.asNondeterministic()(F.col(text_col)))


def filter_documents(docs: DataFrame, text_col: str = "text", rules: Rules = RULES) -> DataFrame:
    """The documents kept, with their bad lines removed; same columns."""
    (out,) = unused(docs, "verdict")
    return judged(docs, text_col, out, rules).where(F.col(f"{out}.kept")).withColumn(text_col, F.coalesce(f"{out}.cleaned", text_col)).drop(out)
