"""Problem 6: broken prompt and response pairs by a multi-label linear classifier.

Features of a (question, text) pair: hashed word n-grams with marks for the text's
start and end; n-grams of *concepts* (negation, knowing and saying, oneself, sources,
politeness), so that a refusal is told by what it says, not by its wording; and pair
features - overlap with the question and the answer, languages of both, how often the
corpus ends a text after its last words (counted over all rows), open brackets.  One
logistic model per defect is trained on a bounded sample of at most ``2 * SAMPLE``
rows: their sound replies, and replies made from them by truncating, by copying the
question, by swapping in replies to questions of other languages (and words of
languages never asked in) and by refusing in sentences put together from parts.  Each
threshold is calibrated on a held-out part of the sample.  A second such model tells
answers that say the information was never given.

Exact checks follow: a text without content is 'empty' only; 'copied' stands only
if nothing but the question is there; a refusal is no case if the row's answer
itself says that the information was never given.  Each field has one defect, the
first of empty, copied, refusal, other_language, truncated.

Null text is 'empty'; a null question has no language and cannot be copied.  Rows
delivered again under the same id count once.  Vocabulary and end statistics keep
what occurs in a fixed share of all rows, so they are bounded at any size by that
share and behave alike at every size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.llm.words import words
from recallframe.session import cut, spread

DEFECTS = ("copied", "refusal", "other_language", "truncated")
#: Rows sampled for training; buckets of the hash; shares of all rows in which a word, or a text's end, must occur.
SAMPLE, HASHED, SEED = 4_000, 1 << 15, 7
WORD_SHARE, END_SHARE, COMMON_SHARE = 1 / 20_000, 1 / 50_000, 1 / 400
MEMORY = 200_000  # tokens whose attributes a worker remembers
TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}+)*|\p{N}+|[^\s\p{L}\p{N}]")
TAIL = regex.compile(r"(?:\s*(?:\(session \d+\)|https?://\S+|[\p{So}\p{Sk}\p{Cf}\p{M}❤️]+))+\s*$")
OPEN_END = regex.compile(r"(?:\b(?:Dr|Mr|Mrs|Ms|St|Nr|No|e\.g|i\.e|z\. ?B|d\. ?h|bzw|p\. ?ej|par ex|Sra?|Dra|Mme)\.|\n\s*\d+\.)\s*$")
CAPTION = regex.compile(r"^\s*[\p{L}]{1,12}(?:\s\p{L}{1,12})?\s*:\s*")
LETTERS = regex.compile(r"\p{L}")
LATIN = regex.compile(r"\p{Script=Latin}")
# Common words of some languages.
COMMON = {
    "en": "the of and to in is you that it was for on are with as his they at be this have from or had by but what were when your there which an do how if not my me i did because about who where why could would should will can may might must we us than then so also".split(),
    "de": "der die das und in zu den nicht von sie ist des sich mit dem er es ein ich auf eine als auch war an hat dass du bei wie wo wer warum wann mir meine habe dir nach aus nur noch kein welchen".split(),
    "fr": "le la les de des et un une du en que qui est dans pour pas sur au ce il elle je tu ne se avec par plus où mon ma mes ton ta tes quand pourquoi combien quel comment était c'est c'était sous très après".split(),
    "es": "el la los las de que y en un una se no por con para su es lo como más pero sus le ya fue este ha sí porque cuando muy sin sobre mi mis tu tus del según dijiste dónde cuándo cómo qué quién cuántas después era hasta".split(),
    "pt": "o a os as do da dos das em um uma não com por mais mas foi isso ao ele ela seu sua ou quando muito nos já eu também só pelo pela até isto logo depois você está".split(),
    "it": "il lo la gli di che e è un una non per con sono come più ma nel nella anche della delle si ne se questo quando molto dove ho hai ha sulla dalla alla già ancora".split(),
    "nl": "het een van en in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit wat naar heeft deze ik je de wij jullie hun dit daar veel moet kan".split(),
    "sv": "och att det som en på är av för med den till inte om ett han men var jag sig från vi så kan när har".split(),
    "pl": "nie się na że do jest jak ale za co to po tak czy był już tylko jego dla przez gdzie kiedy".split(),
}
#: Words of one concept, in the four languages that are asked in.
CONCEPTS = {
    "N": "not no nothing never none nowhere nobody without unable cannot empty lack lacks lacking missing absent impossible unclear unknown hardly nicht nichts nie niemals nirgends nirgendwo ohne kein keine keinen keinem keiner keinerlei unmöglich unklar unbekannt fehlt fehlen leer ne pas rien jamais aucun aucune sans impossible inconnu inconnue vide manque nulle nada nunca jamás ningún ninguna ninguno tampoco sin imposible desconocido vacío vacía falta".split(),
    "K": "know knows known knowledge idea clue aware certain sure tell tells told inform information info detail details data fact facts answer answers answering answerable reply respond response say says said saying state states stated mention mentions mentioned mentioning discussed discuss talk talked recall remember determine determined infer inferred deduce derive guess guessing find found help assist share shared disclose reveal discover comment specify specified describe described cover covers provide provided give given enough sufficient weiß wissen weiss bekannt ahnung angabe angaben auskunft information informationen sagen sagt gesagt beantworten antwort antworten helfen mitteilen erwähnt erwähnen rede steht genannt nennen ableiten finden äußern verraten besprochen sais sait savoir idée renseignement information informations dire dit disent dise répondre réponse aider préciser mentionné mentionnée mention parlé parler trouver déterminer indiqué communiquer discuté sé sabe saber idea información informaciones dato datos decir dice dicen dijo responder respuesta contestar ayudar mencionado mencionada menciona mencionaste mencionó hablar hablado encontrar determinar consta comentar suficiente".split(),
    "S": "i me my mine myself assistant model ich mir mich mein meine meinen meiner je j me moi mon ma mes yo me mí mi mis assistente asistente".split(),
    "C": "note notes context conversation conversations session sessions memory memories record records transcript transcripts history log logs document documents archive entry entries notiz notizen kontext gespräch gesprächen unterhaltung unterlagen verlauf aufzeichnungen protokoll contexte conversation conversations carnet mémoire historique échange échanges contexto conversación conversaciones notas memoria historial apuntes registro registros".split(),
    "P": "sorry unfortunately afraid regret apologies rather prefer decline refuse leider tut möchte lieber bedaure désolé désolée malheureusement regrette préfère hélas siento lamento lamentablemente prefiero perdón".split(),
    "Y": "you your du dir dein deine sie ihr tu te vous votre ton ta usted tú te tus".split(),
}
CONCEPT_OF = {w: c for c, ws in reversed(CONCEPTS.items()) for w in ws}
#: Parts from which refusals are put together, by language; {} takes a made-up name.
REFUSAL_PARTS = {
    "en": [
        (["I"], ["have no way to", "could not possibly", "am in no position to", "don't dare to", "would prefer not to", "decline to", "was not able to", "can not"], ["tell", "say", "recall that", "work this out", "comment on it", "discuss it", "remember this", "reveal that", "find anything on it", "disclose private data", "give a reply"], ["", "", "with any confidence", "from these records", "for you", "about {}"]),
        (["Regrettably I", "I", "As a model I"], ["lack", "am missing", "was given no", "hold no", "see no", "have hardly any", "found no"], ["facts", "data", "clue", "knowledge", "record", "details", "entry", "reply"], ["", "about this", "on {}", "that would tell us", "to go by"]),
        (["The records", "These documents", "The transcript", "My archive", "The history", "Our log"], ["never", "did not", "does not"], ["cover it", "tell us", "discuss {}", "describe this", "reveal it", "specify that", "bring it up"], ["", "", "at all", "so I can only guess"]),
        (["Nothing", "No entry", "No record", "Not one line"], ["here", "in the log", "in the archive", "I was shown", "on file"], ["tells us", "covers {}", "describes this", "reveals it", "answers that"], [""]),
        (["This", "That", "It"], ["could never be", "was not", "remains impossible to be", "is nowhere"], ["found out", "deduced", "recorded", "discussed", "described", "derived", "written down"], ["", "", "from the archive", "as far as I see"]),
        (["No", "Not any", "Hardly any"], ["clue", "data", "record", "knowledge", "answer", "entry"], ["", "", "on that", "at all"]),
        (["My archive", "My index", "The buffer", "My own log"], ["is empty", "is missing", "lacks that"], ["", "", "as of line 4", "at entry 12", "so far"]),
        (["Not a clue", "Unknown to me", "Impossible to tell", "Not sure at all", "No knowledge of that", "My archive is empty", "There is no entry on {}", "There are no data on it", "Beats me, I have nothing"], [""], [""], ["", "I regret"]),
    ],
    "de": [
        (["Ich"], ["kann", "möchte", "darf", "will", "konnte"], ["dazu nichts mitteilen", "das nicht sagen", "hierauf keine Antwort geben", "darüber nicht reden", "das nirgends finden", "Ihnen nicht weiter helfen", "mich dazu lieber nicht äußern"], ["", "leider"]),
        (["Mir"], ["fehlen", "fehlt", "ist dazu nichts"], ["Daten", "die Auskunft", "bekannt", "das Wissen"], ["", "dafür"]),
        (["Hierzu", "Davon", "Darüber"], ["weiß ich", "finde ich", "sagt der Verlauf", "steht im Protokoll", "gibt es"], ["nichts", "keine Auskunft", "keinen Eintrag", "keinerlei Daten"], [""]),
        (["Unklar", "Das ist mir unbekannt", "Das konnte niemand sagen, mir fehlen Daten", "Das geht aus den Unterlagen nicht hervor"], [""], [""], [""]),
    ],
    "fr": [
        (["Je"], ["ne peux", "ne saurais", "ne veux", "ne pourrais"], ["rien dire là-dessus", "pas le dire", "pas donner de réponse", "rien trouver", "pas préciser cela", "pas en parler"], ["", "hélas"]),
        (["Je n'ai", "Il n'y a"], ["aucun", "pas de", "aucune trace de"], ["renseignement", "donnée utile", "réponse", "souvenir"], ["", "pour cela", "sur {}"]),
        (["L'historique", "Le carnet", "L'échange"], ["ne"], ["dit rien de cela", "précise pas ce point", "parle jamais de {}", "mentionne rien"], [""]),
        (["Cela m'est inconnu", "Impossible à dire", "Je regrette, je ne trouve rien", "Je préfère me taire, sans réponse"], [""], [""], [""]),
    ],
    "es": [
        (["No"], ["puedo", "quiero", "podría", "sabría"], ["decirlo", "dar una respuesta", "comentar eso", "encontrar ese dato", "decir nada de {}", "precisarlo"], ["", "lamentablemente"]),
        (["No tengo", "No hay", "Me falta", "No encuentro"], ["ningún", "el"], ["dato", "registro", "apunte", "conocimiento"], ["", "de ello", "sobre {}"]),
        (["El historial", "La conversación", "El registro"], ["no", "nunca"], ["dice eso", "habla de {}", "lo menciona", "contiene ese dato"], [""]),
        (["Lo desconozco", "Imposible decirlo", "Lamento no saber nada", "Eso me es desconocido"], [""], [""], [""]),
    ],
}
#: Parts of answers that say that the information was never given.
NEVER_PARTS = {
    "en": [(["You", "The user", "Nobody"], ["never", "did not", "at no time"], ["told me that", "shared this detail", "talked of it", "brought it up", "gave this fact", "specified it", "described it"], ["", "; you only discussed {}", ". We talked of {} instead"]), (["That detail", "This fact", "The data"], ["was never", "was not", "is absent, it was never", "is missing and was not"], ["shared", "given", "told", "recorded", "discussed"], ["", "; just {} was talked of", ": only {} is recorded"]), (["Cannot be answered", "Impossible to answer", "Unknown"], [", since", ":"], ["you never told", "no session covers it", "no fact was given", "not discussed in any talk"], [""])],
    "de": [(["Du hast"], ["das nie", "davon nichts", "das nicht"], ["gesagt", "erzählt", "genannt", "erwähnt"], [""]), (["Davon", "Darüber"], ["wurde nie", "wurde nicht"], ["gesprochen", "etwas gesagt"], [""])],
    "fr": [(["Tu n'as", "Vous n'avez"], ["jamais", "pas"], ["dit cela", "précisé ce point", "mentionné ce détail", "parlé de cela"], [""])],
    "es": [(["Nunca", "No"], ["dijiste", "hablaste de", "mencionaste", "has dado"], ["eso", "ese dato", "ese detalle"], [""])],
}
#: Replies that use a refusal's words but answer; {} takes the sound reply.
HEDGED = ["I am not sure of the hour, but {}", "Not all of it is on record; still, {}", "No problem at all: {}", "I could not agree more: {}", "I can not say it often enough: {}", "You know this well enough; {}", "It could hardly be clearer: {}", "I can not remember the exact figure, yet {}", "At first nobody knew, and then {}", "You told me that you cannot stand it; {}", "You do not need to ask twice: {}", "no, never", "no, not so far", "nein, nie", "non, jamais", "no, nunca", "You never liked the colour, so you gave it away.", "You could not sleep and read a book instead.", "You did not find the key, so you called a smith.", "Genau weiß ich es nicht, aber {}", "Je ne sais pas au juste, mais {}", "No sé exactamente, pero {}", "You have no car; you take the tram.", "There was nothing left, so you ordered more."]
BEFORE, BEHIND = ["", "", "", "Oh, ", "Regrettably, ", "Well: ", "To be frank, ", "Hm, ", "Going by what I hold: "], ["", "", "", ", my apologies", ". Would you say more?", ". Try the {} folder.", ". What I hold is about {} alone.", ". Only {} shows up in what I hold."]
#: Function words after which no text ends.
CARRY_ON = {"en": "and or but because with of to the a which that so when for from".split(), "de": "und oder aber weil mit von zu der die das wenn für".split(), "fr": "et ou mais parce avec de du la le les que pour".split(), "es": "y o pero porque con de del la el los que para".split()}
#: Placeholders for nothing, without signs around them.
NOTHING = set("none null n/a na nan nil empty blank undefined missing no_answer no_response no_content noanswer no_reply not_available keine_antwort leer vide vacío ninguno ninguna aucune aucun sin_respuesta pas_de_réponse".split())
_CONTENT = regex.compile(r"[\p{L}\p{N}/]+")


def content(text: str | None) -> str:
    """What is left without marks, brackets and blanks; '' for placeholders of nothing."""
    if not text:
        return ""
    kept = "_".join(_CONTENT.findall(text if len(text) < 400 else text[:200] + text[-200:])).strip("/_").lower()
    return "" if kept in NOTHING else kept


def copied(question: str | None, text: str | None) -> bool:
    """The question once or twice, with at most a word missing, and nothing else but a caption."""
    q = words(question)
    if not q:
        return False
    for t in (words(text), words(CAPTION.sub("", text or "", count=1))):
        for ref in (q, q + q):
            if t == ref:
                return True
            if len(t) == len(ref) - 1 and len(q) > 2:
                i = next((i for i, (a, b) in enumerate(zip(t, ref)) if a != b), len(t))
                if t[i:] == ref[i + 1 :]:
                    return True
    return False


KINDS = list(COMMON)
_SEED: dict[str, set[str]] = defaultdict(set)
for _k, _ws in COMMON.items():
    for _w in _ws:
        _SEED[_w].add(_k)


def concept(token: str) -> str:
    """The concept of a lower-case token, '' for none; contracted negations count as such."""
    if token in CONCEPT_OF:
        return CONCEPT_OF[token]
    if "'" in token or "’" in token:
        parts = token.replace("’", "'").split("'")
        if token.endswith(("n't", "n’t")) or parts[0] == "n":
            return "N"
        return next((CONCEPT_OF[p] for p in (parts[-1], parts[0]) if p in CONCEPT_OF), "")
    return ""


def body_of(text: str) -> str:
    """The text without emphasis around it and without session marks, links and emoji at its end."""
    text = text.strip().strip("*_`").rstrip()
    end = text[-1:]
    return text if end.isascii() and end != ")" and "http" not in text[-120:] else TAIL.sub("", text).rstrip("*_` ")


def whole_end(text: str, body: str | None = None) -> bool:
    """Whether the text ends like a finished one: a full stop that is none of an abbreviation, or a signature mark."""
    body = body_of(text) if body is None else body
    bare = body.rstrip().rstrip("\"'»”’)]*_").rstrip()
    return (bare.endswith((".", "!", "?", "…", "。", "！", "？")) or TAIL.search(text[-160:].rstrip("*_` ")) is not None) and not (bare.endswith(".") and OPEN_END.search(body[-24:]))


_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * _P
        out ^= out >> np.uint64(29)
    return out


def _number(x: int) -> np.uint64:
    return np.uint64((x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)


class Rows:
    """Tokens of many texts laid end to end, and attributes of each distinct token."""

    def __init__(self, texts: list[str]):
        self.lists = [TOKEN.findall(t) for t in texts]
        index: dict[str, int] = {}
        self.size = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.code = np.fromiter((index.setdefault(t, len(index)) for own in self.lists for t in own), dtype=np.int64, count=int(self.size.sum()))
        self.tokens = list(index)
        self.row = np.repeat(np.arange(len(texts)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.code)) - self.first[self.row]
        self.last = self.first + self.size - 1  # of rows that are not empty

    def before(self, values: np.ndarray, n: int) -> np.ndarray:
        """The value n places before in the same row, 0 where there is none."""
        out = np.zeros_like(values)
        if n < len(values):
            out[n:] = values[:-n]
        out[self.place < n] = 0
        return out


#: Attributes of a token: hash of its lower-case form, letter, number, lower case first, seed language or concept.
def _attributes(token: str) -> tuple:
    low = token.lower()
    letters = len(LETTERS.findall(token)) if not token.isascii() else sum(c.isalpha() for c in token)
    foreign = letters - (letters if token.isascii() else len(LATIN.findall(token)))
    return (xxhash.xxh64_intdigest(low), token[0].isalpha(), token[0].isnumeric(), token[0].islower(), low in _SEED, " NKSCPY".index(concept(low) or " "), letters, foreign)


_KNOWN: dict[str, tuple] = {}


def attributes(tokens: list[str]) -> dict[str, np.ndarray]:
    rows = []
    for t in tokens:
        own = _KNOWN.get(t)
        if own is None:
            own = _attributes(t)
            if len(_KNOWN) < MEMORY:
                _KNOWN[t] = own
        rows.append(own)
    names = ("hash", "alpha", "numeric", "lower", "seed", "concept", "letters", "foreign")
    kinds = (np.uint64, bool, bool, bool, bool, np.int64, np.int64, np.int64)
    return {n: np.array([r[i] for r in rows], dtype=k) for i, (n, k) in enumerate(zip(names, kinds))}


_SEED_WEIGHT = {w: np.array([(k in ks) / len(ks) for k in KINDS]) for w, ks in _SEED.items()}


def seed_languages(texts: list[str | None]) -> np.ndarray:
    """Index in KINDS of each text's language by common words alone, -1 for none or a tie."""
    rows = Rows([t or "" for t in texts])
    low = [t.lower() for t in rows.tokens]
    own = np.array([w in _SEED for w in low], dtype=bool)
    if not own.any():
        return np.full(len(texts), -1)
    table = np.array([_SEED_WEIGHT[w] if w in _SEED else np.zeros(len(KINDS)) for w in low])
    keep = own[rows.code]
    score = np.zeros((len(texts), len(KINDS)))
    np.add.at(score, rows.row[keep], table[rows.code[keep]])
    order = np.sort(score, axis=1)
    return np.where((order[:, -1] > 0) & (order[:, -1] > order[:, -2] + 1e-9), score.argmax(axis=1), -1)


class Corpus:
    """Counts over all rows: words with the languages they are used in, and ends of texts."""

    def __init__(self):
        self.words, self.languages, self.common = np.zeros(0, dtype=np.uint64), np.zeros((0, len(KINDS))), np.zeros(0, dtype=bool)
        self.ends, self.odds = np.zeros(0, dtype=np.uint64), np.zeros(0)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the vocabulary, -1 for words outside of it."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def masked(self, own: dict[str, np.ndarray]) -> np.ndarray:
        """Hash of each distinct token: numbers are alike, and so are words outside of the vocabulary."""
        known = self.place(own["hash"]) >= 0
        return np.where(own["numeric"], _number(1), np.where(own["alpha"] & ~known & ~own["seed"], _number(2), own["hash"]))

    def coarse(self, own: dict[str, np.ndarray]) -> np.ndarray:
        """Like ``masked``, but all words that are not common are alike by case and by being known."""
        at = self.place(own["hash"])
        usual = own["seed"] | ((at >= 0) & self.common[np.maximum(at, 0)] if len(self.common) else False)
        shape = 4 + own["lower"].astype(np.uint64) + 2 * (at >= 0).astype(np.uint64)
        return np.where(own["numeric"], _number(1), np.where(own["alpha"] & ~usual, shape * _P, own["hash"]))

    def end_odds(self, keys: np.ndarray) -> np.ndarray:
        """How often the corpus ends after a context, NaN for unseen ones."""
        if not len(self.ends):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.ends, keys), len(self.ends) - 1)
        return np.where(self.ends[at] == keys, self.odds[at], np.nan)


def contexts(rows: Rows, key: np.ndarray, coarse: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last one, two and three tokens at each place, then of two and three coarse ones."""
    a, b, c, d = rows.before(key, 1), rows.before(key, 2), rows.before(coarse, 1), rows.before(coarse, 2)
    one = lambda n: np.full(len(key), _number(10 + n), dtype=np.uint64)
    return [_mix(one(1), key), _mix(one(2), a, key), _mix(one(3), b, a, key), _mix(one(4), c, coarse), _mix(one(5), d, c, coarse)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def corpus(pairs: DataFrame) -> Corpus:
    """Statistics over all pairs, added up in Spark; what a fixed share of rows holds reaches the driver."""
    total = pairs.count()
    base = Corpus()

    def word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = Rows([t or "" for t in pdf["text"]])
            lang, spoken = seed_languages(pdf["question"].tolist()), seed_languages(pdf["text"].tolist())
            lang = np.where((spoken >= 0) & (spoken != lang), -1, lang)  # replies in another language tell nothing
            own = attributes(rows.tokens)
            keep = own["alpha"][rows.code] & (rows.place < rows.size[rows.row] - 1)  # the last word of a text may be cut off
            pair = np.unique(rows.row[keep] * len(rows.tokens) + rows.code[keep])  # a word counts once a row
            k = lang[pair // max(1, len(rows.tokens))]
            both, c = np.unique(np.stack([_signed(own["hash"])[pair % max(1, len(rows.tokens))], k], axis=1), axis=0, return_counts=True)
            yield pd.DataFrame({"w": both[:, 0], "k": both[:, 1].astype("int32"), "c": c.astype("int64")})

    least = max(8, int(total * WORD_SHARE))
    by_word = pairs.mapInPandas(word_counts, "w long, k int, c long").groupBy("w", "k").agg(F.sum("c").alias("c"))
    wide = cut(by_word.groupBy("w").agg(F.sum("c").alias("n"), *(F.sum(F.when(F.col("k") == i, F.col("c")).otherwise(0)).alias(k) for i, k in enumerate(KINDS))).where(F.col("n") >= least))
    got = wide.toPandas()
    hashes = got["w"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    v = got[KINDS].to_numpy(dtype=float)[order].reshape(len(got), len(KINDS))
    prior = (v.sum(axis=0) + 1) / (v.sum() + len(KINDS))
    main = prior > 0.01  # languages in which questions are asked
    share = (v + 12 * prior) / prior * main
    share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12)
    base.words, base.languages, base.common = hashes[order], share, got["n"].to_numpy(dtype=float)[order] >= max(8.0, total * COMMON_SHARE)
    seeds = {xxhash.xxh64_intdigest(w): np.array([k in ks for k in KINDS], dtype=float) for w, ks in _SEED.items()}
    extra = []
    at = base.place(np.array(list(seeds), dtype=np.uint64))
    for (h, own), i in zip(seeds.items(), at):
        if i < 0:
            extra.append((h, own / own.sum()))
        elif not (own * main).any():  # common words keep their own languages
            base.languages[i] = own / own.sum()
    if extra:
        all_words = np.concatenate([base.words, np.array([h for h, _ in extra], dtype=np.uint64)])
        order = np.argsort(all_words)
        base.languages = np.concatenate([base.languages, np.array([x for _, x in extra])])[order]
        base.words, base.common = all_words[order], np.concatenate([base.common, np.zeros(len(extra), dtype=bool)])[order]
    shared = pairs.sparkSession.sparkContext.broadcast(base)

    def end_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = Rows([body_of(t or "") for t in pdf["text"]])
            own = attributes(rows.tokens)
            last = rows.place == rows.size[rows.row] - 1
            keys, ends = np.concatenate(contexts(rows, shared.value.masked(own)[rows.code], shared.value.coarse(own)[rows.code])), np.tile(last, 5)
            k, back, n = np.unique(keys, return_inverse=True, return_counts=True)
            yield pd.DataFrame({"k": _signed(k), "n": n.astype("int64"), "e": np.bincount(back, weights=ends, minlength=len(k)).astype("int64")})

    least = max(4, int(total * END_SHARE))
    ends = pairs.mapInPandas(end_counts, "k long, n long, e long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).where(F.col("n") >= least).toPandas()
    keys = ends["k"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    base.ends = keys[order]
    base.odds = np.log((ends["e"].to_numpy(dtype=float) + 0.3) / (ends["n"].to_numpy(dtype=float) + 6.0))[order]
    return base


class Features:
    """Dense and hashed features of a batch of (question, text, answer)."""

    def __init__(self, base: Corpus, questions: list, texts: list, answers: list, only_ideas: bool = False):
        n = len(texts)
        texts = [t or "" for t in texts]
        bodies = [body_of(t) for t in texts]
        rows, asked = Rows(bodies), Rows([q or "" for q in questions])
        own = attributes(rows.tokens)
        some = rows.size > 0
        lasts = rows.last[some]
        masked = base.masked(own)
        key = masked[rows.code]
        spot = base.place(own["hash"])
        known = (spot >= 0) | own["seed"]
        # sets of words, and what the text shares with the question and the answer
        memo: dict = {None: frozenset()}

        def word_set(t: str | None) -> frozenset:
            own_ = memo.get(t)
            if own_ is None:
                own_ = memo[t] = frozenset(words(t))
            return own_

        cover, only_q, whole_copy, piece, strange, closed, lists, marks = (np.zeros(n) for _ in range(8))
        unknown_last = np.zeros(n, dtype=bool)
        unknown_last[some] = (own["alpha"] & ~known)[rows.code[lasts]]
        for i, (q, t, b, a) in enumerate(zip(questions, texts, bodies, answers)):
            tq, ta, tt = word_set(q), word_set(a), word_set(t)
            cover[i] = len(ta & tt) / max(1, len(ta))
            rest = len(tt - tq)
            only_q[i] = rest / max(1, len(tt))
            if rest <= 2 and tt:
                whole_copy[i] = copied(q, t)
            closed[i] = whole_end(t, b)
            lists[i] = b[-1:] == "." and bool(OPEN_END.search(b[-24:]))
            marks[i] = b.count("(") > b.count(")") or b.count('"') % 2 or b.count("«") > b.count("»")
            if unknown_last[i]:
                last = rows.lists[i][-1]
                low = last.lower()
                if low not in tq and low not in ta:
                    piece[i] = any(w.startswith(low) for w in tq | ta)
                    strange[i] = last[0].islower() and not closed[i]
        self.cover, self.copy = cover, whole_copy > 0
        open_ = 1 - closed
        ctx = contexts(rows, key, base.coarse(own)[rows.code])
        odds = np.full((n, 5), -3.0)
        seen = np.zeros((n, 5), dtype=bool)
        for k in range(5):
            got = base.end_odds(ctx[k][lasts])
            seen[some, k] = ~np.isnan(got)
            odds[some, k] = np.where(np.isnan(got), -3.0, got)
        self.usual = seen[:, 2] & (odds[:, 2] > math.log(0.15))
        # languages of both
        asked_in = seed_languages(questions)
        weight = np.where(spot[:, None] >= 0, base.languages[np.maximum(spot, 0)] if len(base.words) else 0.0, 0.0)
        if not len(base.words):
            weight = np.zeros((len(rows.tokens), len(KINDS)))
        tells = own["alpha"] & (weight.max(axis=1, initial=0.0) > 0.55) & (own["seed"] | (own["letters"] > 1))
        pair = np.unique(rows.row * max(1, len(rows.tokens)) + rows.code)
        pr, pc = pair // max(1, len(rows.tokens)), pair % max(1, len(rows.tokens))
        keep = tells[pc]
        votes = np.zeros((n, len(KINDS)))
        np.add.at(votes, pr[keep], np.log(weight[pc[keep]] + 0.02) - math.log(0.3))
        voters = np.bincount(pr[keep], minlength=n)
        own_vote = votes[np.arange(n), np.maximum(asked_in, 0)]
        others = votes.copy()
        others[np.arange(n), np.maximum(asked_in, 0)] = -np.inf
        margin = np.where((asked_in >= 0) & (voters > 0), others.max(axis=1) - own_vote, 0.0)
        letters = np.bincount(rows.row, weights=own["letters"][rows.code], minlength=n)
        foreign = np.bincount(rows.row, weights=own["foreign"][rows.code], minlength=n) / np.maximum(1, letters)
        self.margin, self.foreign, self.asked_in = margin, foreign, asked_in
        # concepts, in the first sentence and in all
        kind = own["concept"][rows.code]
        in_question = self._in_question(rows, asked)
        alpha = own["alpha"][rows.code]
        spoken = np.cumsum(alpha)
        spoken = spoken - np.where(rows.first < len(spoken), spoken[np.minimum(rows.first, max(0, len(spoken) - 1))] - alpha[np.minimum(rows.first, max(0, len(spoken) - 1))], 0)[rows.row] if len(spoken) else spoken
        stop = np.isin(key, [np.uint64(xxhash.xxh64_intdigest(x)) for x in ".!?;"]) & (spoken >= 3)
        head = np.full(n, 1 << 40)
        np.minimum.at(head, rows.row[stop], rows.place[stop])
        first = rows.place <= head[rows.row]
        has = np.zeros((n, 7))
        np.add.at(has, (rows.row[first], kind[first]), 1)
        plain = alpha & (kind == 0) & ~own["seed"][rows.code]
        said = np.bincount(rows.row[first], weights=(plain & ~in_question)[first], minlength=n)
        numbers = np.bincount(rows.row[first], weights=(own["numeric"][rows.code] & ~in_question)[first], minlength=n)
        no, know, self_, source, polite, you = (has[:, i] > 0 for i in range(1, 7))
        length = rows.size
        function = np.zeros(n)
        function[some] = own["seed"][rows.code[lasts]]
        self.declines = no & (know | source)
        self.dense = np.stack(
            [
                np.ones(n), closed, *(open_ * odds[:, k] for k in range(5)), open_ * (odds[:, 4] > -1), open_ * ~seen[:, 4], open_ * ~seen[:, 2], closed * odds[:, 1], closed * odds[:, 2], piece, strange, marks, lists,
                np.tanh(margin / 3), np.maximum(0.0, np.tanh(margin)), margin > 0.5, margin > 2.0, voters == 0, foreign, foreign > 0.3,
                cover, cover >= 0.99, only_q, only_q == 0, whole_copy, np.minimum(length, 40) / 40, length <= 3,
                np.where(seen[:, 2], open_ * np.minimum(0.0, odds[:, 2] + 2.0), 0.0), open_ * np.minimum(0.0, odds[:, 1] + 2.0), function * open_,
                
                *(ideas := (no, know, source, polite, no & know, no & source, no & self_, no & you, self_ & know & no, np.minimum(has[:, 2], 3) / 3, (no & know) * (said == 0), (no & (know | source)) * np.minimum(said, 6) / 6, np.minimum(said, 8) / 8, numbers > 0, (no & know) * (numbers > 0), polite & (know | source), ~no & ~polite)),
            ],
            axis=1,
        ).astype(float)
        self.ideas = np.stack([np.ones(n), *ideas], axis=1).astype(float)
        # hashed n-grams: of words (Q for a word of the question), of the start and the end, and of concepts
        word = np.where(in_question & ~own["seed"][rows.code], _number(3), key)
        a, b = rows.before(word, 1), rows.before(word, 2)
        salt = lambda x, n_: np.full(n_, _number(x), dtype=np.uint64)
        size = len(word)
        two, three = rows.place >= 1, rows.place >= 2
        parts = [(rows.row, _mix(salt(20, size), word)), (rows.row[two], _mix(salt(21, size), a, word)[two]), (rows.row[three], _mix(salt(22, size), b, a, word)[three])]
        for m in (1, 2, 3):
            at = rows.place == m - 1
            parts.append((rows.row[at], _mix(salt(30 + m, size), b if m > 2 else salt(0, size), a if m > 1 else salt(0, size), word)[at]))
        for m in (1, 2):
            parts.append((np.flatnonzero(some), _mix(salt(40 + m, size), a if m > 1 else salt(0, size), word)[lasts]))
        idea = kind > 0
        crow, ckind = rows.row[idea], kind[idea].astype(np.uint64)
        for m in (1, 2, 3):
            many = max(0, len(ckind) - m + 1)
            same = crow[m - 1 :] == crow[:many] if many else np.zeros(0, dtype=bool)
            grams = _mix(salt(50 + m, many), *(ckind[j : many + j] for j in range(m)))
            parts.append((crow[m - 1 :][same] if many else crow[:0], grams[same]))
        if only_ideas:
            parts, self.dense = parts[-3:], self.ideas
            parts.append((np.arange(n), np.full(n, _number(60))))
        every = np.concatenate([r for r, _ in parts]) * HASHED + (np.concatenate([h for _, h in parts]) % np.uint64(HASHED)).astype(np.int64)
        every = np.unique(every)
        self.row, self.bucket = every // HASHED, every % HASHED
        self.start = np.searchsorted(self.row, np.arange(n + 1))

    @staticmethod
    def _in_question(rows: Rows, asked: Rows) -> np.ndarray:
        """Whether each token occurs in the question of its row."""
        index = {t.lower(): i for i, t in enumerate(asked.tokens)}
        width = max(1, len(asked.tokens))
        low = np.array([index.get(t.lower(), -1) for t in asked.tokens], dtype=np.int64)
        mine = np.array([index.get(t.lower(), -1) for t in rows.tokens], dtype=np.int64)
        held = np.unique(asked.row * width + (low[asked.code] if len(low) else asked.code))
        code = mine[rows.code] if len(mine) else rows.code
        return (code >= 0) & np.isin(rows.row * width + code, held)

    def take(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the batch, bucket) of some rows."""
        n = self.start[own + 1] - self.start[own]
        at = np.repeat(self.start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(own)), n), self.bucket[at]


class Linear:
    """One logistic model per defect over hashed and dense features, with calibrated thresholds."""

    def __init__(self, width: int, kinds: int = len(DEFECTS)):
        self.w, self.v = np.zeros((HASHED, kinds)), np.zeros((width, kinds))
        self.at = np.full(kinds, 0.5)

    def scores(self, f: Features, own: np.ndarray | None = None) -> np.ndarray:
        own = np.arange(len(f.dense)) if own is None else own
        who, bucket = f.take(own)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(who, minlength=len(own))))
        z = f.dense[own] @ self.v
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(who, weights=self.w[bucket, k], minlength=len(own)) * scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, f: Features, y: np.ndarray, epochs: int = 20, rate: float = 0.3) -> Linear:
        n = len(y)
        if not n:
            return self
        rng = np.random.default_rng(SEED)
        hold = rng.random(n) < 0.2
        fit = np.flatnonzero(~hold)
        epochs = max(epochs, min(60, 80_000 // n))  # a small sample is gone through more often
        gw, gv = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3)
        for _ in range(epochs):
            rng.shuffle(fit)
            for lo in range(0, len(fit), 128):
                own = fit[lo : lo + 128]
                e = self.scores(f, own) - y[own]
                who, bucket = f.take(own)
                scale = 1 / np.sqrt(np.maximum(1, np.bincount(who, minlength=len(own))))
                touched, back = np.unique(bucket, return_inverse=True)
                grad = np.stack([np.bincount(back, weights=(e[:, k] * scale)[who], minlength=len(touched)) for k in range(e.shape[1])], axis=1)
                grad = grad / len(own) + 2e-5 * self.w[touched]
                gw[touched] += grad**2
                self.w[touched] -= rate * grad / np.sqrt(gw[touched])
                gd = f.dense[own].T @ e / len(own) + 1e-5 * self.v
                gv += gd**2
                self.v -= rate * gd / np.sqrt(gv)
        held = np.flatnonzero(hold)
        if len(held):
            p = self.scores(f, held)
            for k in range(y.shape[1]):
                grid = np.linspace(0.3, 0.9, 25)
                f1 = [2 * ((p[:, k] >= t) & (y[held, k] > 0)).sum() / max(1, (p[:, k] >= t).sum() + (y[held, k] > 0).sum()) for t in grid]
                good = grid[np.flatnonzero(np.array(f1) >= max(f1) - 1e-3)]
                self.at[k] = good[len(good) // 2]  # the middle of the best thresholds
        return self


def _named(text: str, rng: np.random.Generator) -> str:
    made = "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(3)) + rng.choice(list("bdklmnrst"))
    return text.replace("{}", made.capitalize())


def _composed(parts: list, rng: np.random.Generator) -> str:
    """A sentence from one part of each place of a randomly taken pattern."""
    chosen = parts[int(rng.integers(len(parts)))]
    return regex.sub(r" +(?=[,;.:]|$)", "", " ".join(p for p in (own[int(rng.integers(len(own)))] for own in chosen) if p))


_SCRIPTS = ("あいうえおかきくけこさしすせそたちつてと", "абвгдежзиклмнопрстуя", "的一是不了人我在有他这中大来上个国", "ابتثجحخدذرزسشصضط", "가나다라마바사아자차카타파하")


def _foreign(rng: np.random.Generator, lang: int) -> str:
    """Words of a language never asked in, or letters of another script."""
    if rng.random() < 0.3:
        own = list(_SCRIPTS[int(rng.integers(len(_SCRIPTS)))])
        return " ".join("".join(rng.choice(own, int(rng.integers(2, 8)))) for _ in range(int(rng.integers(1, 8))))
    k = int(rng.choice([i for i in range(len(KINDS)) if i != lang]))
    ws = list(rng.choice(COMMON[KINDS[k]], int(rng.integers(3, 10))))
    for _ in range(int(rng.integers(1, 4))):
        ws.insert(int(rng.integers(len(ws) + 1)), _named("{}", rng).lower() if rng.random() < 0.7 else _named("{}", rng))
    text = " ".join(ws)
    return text[0].upper() + text[1:] + ("." if rng.random() < 0.7 else "")


def examples(base: Corpus, rows: list[tuple]) -> list[tuple]:
    """(question, text, answer, defect or None) made from sampled (question, text, answer)."""
    rng = np.random.default_rng(SEED)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = [(q, t, a) for q, t, a in rows if q and content(t) and not copied(q, t)]
    if not rows:
        return []
    f = Features(base, *map(list, zip(*rows)))
    keep = (f.margin <= 0.3) & (f.foreign <= 0.2) & f.usual & ~(f.declines & (f.cover < 0.99))
    sound = [r for r, ok, c in zip(rows, keep, f.cover) if ok and (c >= 0.99 or whole_end(r[1]))]
    golds = [(q, a, None) for q, _, a in sound if a and content(a) and not copied(q, a)]
    if golds:
        g = Features(base, *map(list, zip(*golds)))
        golds = [r for r, ok in zip(golds, g.usual & (g.margin < 0.3) & (g.foreign < 0.2) & ~g.declines) if ok]
    sound = sound + golds[: len(sound) // 2]
    langs = seed_languages([q for q, *_ in sound]) if sound else []
    by_lang = defaultdict(list)
    spoken = defaultdict(list)  # replies whose own words show the language
    for (_, t, _), k, own in zip(sound, langs, seed_languages([t for _, t, _ in sound]) if sound else []):
        by_lang[int(k)].append(t)
        if own == k:
            spoken[int(k)].append(t)
    out: list[tuple] = [(q, t, a, None) for q, t, a in sound]
    for (q, t, a), k in zip(sound, langs):
        k = int(k)
        lang = KINDS[k] if k >= 0 and KINDS[k] in REFUSAL_PARTS else "en"
        made: list[tuple[str, str | None]] = []
        ts = t.rstrip()
        on = lambda: " " + " ".join([*(pick(COMMON[lang]) for _ in range(int(rng.integers(0, 3)))), pick(CARRY_ON[lang] if rng.random() < 0.6 else COMMON[lang])])
        after = lambda: pick(["", ",", " (", ', "', ":"]) + on() if rng.random() < 0.85 else pick([" Dr.", " e.g.", " z. B.", "\n1. " + pick(by_lang[k]).split(" ")[0] + "\n2."])
        if len(ts) > 12:
            at = int(rng.integers(len(ts) // 4, len(ts) - 2))
            cut_ = ts[:at].rstrip()
            rest = ts[len(cut_) :].strip(" .!?*\n")
            if rest and len(cut_) > 3 and not cut_.endswith((".", "!", "?")):
                made.append((cut_, "truncated"))
            word_end = ts[:at].rsplit(" ", 1)[0]
            made.append(((word_end if len(word_end) > 3 else ts.rstrip(".!?")) + after(), "truncated"))
        if rng.random() < 0.4:
            made.append((ts.rstrip(".!?*") + after(), "truncated"))
        for _ in range(2):
            r = _composed(REFUSAL_PARTS[lang], rng)
            b, z = (pick(BEFORE), pick(BEHIND)) if lang == "en" else ("", pick(["", ".", "!"]))
            if b and not r.startswith(("I ", "As")):
                r = r[0].lower() + r[1:]
            full = _named(b + r + z, rng)
            full = full if full.endswith(("?", ".", "!")) or rng.random() < 0.3 else full + "."
            full = full if rng.random() < 0.85 else full.lower()
            made.append((f"**{full}**" if rng.random() < 0.1 else full, "refusal"))
        others = [x for x in spoken if x != k and x >= 0]
        if others and rng.random() < 0.7:
            made.append((pick(spoken[pick(others)]), "other_language"))
        if rng.random() < 0.4:
            made.append((_foreign(rng, k), "other_language"))
        if rng.random() < 0.4:
            ws = q.split()
            gone = int(rng.integers(len(ws)))
            made.append((pick([q, q.lower(), q + " " + q, "Question: " + q, q.upper(), " ".join(ws[:gone] + ws[gone + 1 :]) or q]), "copied"))
            made.append((q + " " + t, None))
        if rng.random() < 0.5:
            made.append((_named(pick(HEDGED), rng).replace("{}", t) if rng.random() < 0.5 else pick(HEDGED).replace("{}", t), None))
        out += [(q, m, a if rng.random() < 0.7 else None, d) for m, d in made if content(m)]
    return out


class Judge:
    def __init__(self, base: Corpus, model: Linear, given: Linear):
        self.base, self.model, self.given = base, model, given

    def never_given(self, answers: list[str | None]) -> np.ndarray:
        none = [None] * len(answers)
        f = Features(self.base, none, answers, none, only_ideas=True)
        return (self.given.scores(f)[:, 0] >= self.given.at[0]) & f.declines

    def defects(self, questions: list, texts: list, answers: list, may_refuse: list[bool]) -> list[str | None]:
        out: list[str | None] = ["empty" if not content(t) else None for t in texts]
        todo = [i for i, x in enumerate(out) if x is None]
        if not todo:
            return out
        f = Features(self.base, *([x[i] for i in todo] for x in (questions, texts, answers)))
        hit = self.model.scores(f) >= self.model.at
        refusals = [j for j in range(len(todo)) if hit[j, 1] and may_refuse[todo[j]]]
        right = dict(zip(refusals, self.never_given([answers[todo[j]] for j in refusals]))) if refusals else {}
        for j, i in enumerate(todo):
            if hit[j, 0] and f.copy[j]:
                out[i] = "copied"
            elif hit[j, 1] and f.cover[j] < 0.99 and may_refuse[i]:
                out[i] = None if right[j] else "refusal"
            elif hit[j, 2]:
                out[i] = "other_language"
            elif hit[j, 3] and not hit[j, 1]:
                out[i] = "truncated"
        return out


def fit(pairs: DataFrame) -> Judge:
    """Statistics over all pairs, models from a bounded sample of them."""
    base = corpus(pairs)
    n = pairs.count()
    take = pairs.where(F.pmod(F.xxhash64("question", "text", "answer"), F.lit(max(1, n // SAMPLE))) == 0) if n > SAMPLE else pairs
    rows = [tuple(r) for r in take.select("question", "text", "answer").dropDuplicates().orderBy("question", "text", "answer").limit(2 * SAMPLE).collect()]
    made = examples(base, rows)
    f = Features(base, *(list(x) for x in zip(*[m[:3] for m in made]))) if made else Features(base, [], [], [])
    y = np.array([[m[3] == x for x in DEFECTS] for m in made], dtype=float).reshape(-1, len(DEFECTS))
    model = Linear(f.dense.shape[1]).train(f, y)
    rng = np.random.default_rng(SEED)
    yes = list(dict.fromkeys(_named(_composed(parts, rng), rng) + "." for parts in NEVER_PARTS.values() for _ in range(120)))
    plain = lambda ts: list(dict.fromkeys(t for t in ts if t))[:1500]
    no = plain(m[1] for m in made if m[3] is None)
    # sound replies may themselves say that nothing was given: those that decline teach nothing here, hedged ones do
    no = [t for t, declines in zip(no, Features(base, [None] * len(no), no, [None] * len(no), only_ideas=True).declines) if not declines]
    no += [HEDGED[i % len(HEDGED)].replace("{}", t) for i, t in enumerate(no[:300])]
    none = [None] * (len(yes) + len(no))
    g = Features(base, none, yes + no, none, only_ideas=True)
    given = Linear(g.dense.shape[1], 1).train(g, np.array([[1.0]] * len(yes) + [[0.0]] * len(no)))
    return Judge(base, model, given)


def defects(pairs: DataFrame) -> DataFrame:
    """``src, row_id, field, defect`` of ``src, row_id, field, question, text, answer, may_refuse``.

    ``answer`` is the row's right answer for a reply, null where the text is that answer itself.
    """
    pairs = cut(spread(pairs))
    judge = pairs.sparkSession.sparkContext.broadcast(fit(pairs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                found = judge.value.defects(*(part[c].tolist() for c in ("question", "text", "answer", "may_refuse")))
                yield part[["src", "row_id", "field"]].assign(defect=found)[[x is not None for x in found]]

    return pairs.mapInPandas(run, "src string, row_id long, field string, defect string")
