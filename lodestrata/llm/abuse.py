"""Problem 8: abusive, hateful or sexual content.

Method: noisy-channel deobfuscation. A character trigram model is counted over
all documents (27 letters-and-space symbols, digits and other signs as one
symbol each, so its table is bounded). Every token that looks disguised opens a
lattice: look-alike signs and digits stand for letters, a star for any letter,
repeated signs for one, separators for none, two neighbours for their swap.
Viterbi decoding finds the cheapest reading through the lattice: a word that can
do harm or aim it, or, where there is none, the letters that the character model
finds likeliest; it is kept if it explains the token better than the literal
reading does.

The restored text is then scored. Words have roles (an insult, a harmful verb, a
group of people, a thing of code ...), in several languages; a sentence has a
feature where a harmful role stands in the right relation to a person: an insult
said of someone, violence with someone as its object, a group called vermin.
Words that qualify things, are denied, said of oneself or quoted as examples
make none. Few idioms have no such structure and are given as they are. The
score is logistic in the features of a document, with weights fitted on at most
MAX_LABELLED labelled documents and drawn to fixed ones, which stand where there
are no labels.

Defined results: null and blank texts score 0; repeated ids keep their rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.leakage import repaired
from lodestrata.sources.tables import cut

FOUND_FROM = 0.5
#: Labelled documents the weights are fitted on at most, taken in the order of a hash of their ids.
MAX_LABELLED = 20_000

# Fixed word lists by what a word can be in a sentence, folded when read; endings are added by rule.
ROLES = {
    "insult": """
idiot moron cretin imbecile dimwit halfwit dumbass jackass scumbag bastard loser clown asshole arsehole bitch bellend
wanker prick retard douchebag douche dipshit shithead dickhead motherfucker fucker cunt whore slut twat tosser numbskull nitwit
simpleton lowlife swine freak creep coward bonehead blockhead knucklehead airhead buffoon bozo dunce halfbrain nutjob pervert psycho
scoundrel skank sleazebag maggot turd weirdo wimp ignoramus dullard dolt dumbo dingbat degenerate incel faggot tranny nigger kike
trottel vollidiot depp arschloch bloedmann blodmann dummkopf penner wichser schwachkopf versager hurensohn drecksau mistkerl arsch fotze schlampe missgeburt spast miststueck miststuck
connard connasse abruti debile salope salaud ordure bouffon minable encule cretine imbecile couillon petasse batard raclure tocard
idiota imbecil estupido estupida gilipollas cabron tonto tonta pendejo subnormal payaso inutil idiote capullo zorra puta maricon mierdecilla
cretino stronzo coglione deficiente bastardo troia puttana scemo babbeo otario babaca burro vadia idioot klootzak eikel sukkel trut hoer
идиот дурак дура дебил мудак сволочь тварь придурок урод кретин козел сука мразь ублюдок дебилка тупица kretyn debil glupek skurwysyn
""",
    "weak": "pig worm rat snake failure disgrace joke nobody trash garbage rubbish filth scum waste fool hack fraud toad leech muppet donkey ape monkey dog cow sheep parasite cockroach stain mistake liar dreck abfall schwein ratte porc chien rat nul nulle cerdo perro rata basura porco maiale lixo schwijn свинья мусор ничтожество",
    "demean": "stupid pathetic worthless ugly dumb useless disgusting brainless incompetent spineless filthy lazy fat talentless hopeless clueless gutless mindless retarded repulsive revolting stinking vile despicable contemptible laughable inferior dämlich dämlicher dämliche blöd blöder blöde dumm dummer dumme hässlich wertlos nutzlos erbärmlich erbärmlicher faul widerlich stupide bête moche inutile pathétique lamentable répugnant fea feo asqueroso asquerosa patético patética inútil vago estúpido estúpida inferiores brutto brutta schifoso patetico feia feio nojento lelijk dom waardeloos тупой тупая жалкий жалкая никчемный",
    "dehuman": "vermin subhuman subhumans parasites cockroaches savages animals beasts pests scum filth untermensch untermenschen abschaum ungeziefer parasiten schädlinge vermine racaille cafards nuisibles sous-hommes escoria ratas alimañas parásitos infrahumanos feccia parassiti escória ungedierte uitschot недочеловеки паразиты нелюди",
    "violence": "kill murder hurt beat stab shoot strangle rape choke hang gas burn punch slap smash destroy bury lynch slaughter drown torture cripple maim behead hunt break cut slit skin crush bash whip end erase eliminate exterminate kick töten umbringen erschlagen verprügeln schlagen vergasen erwürgen tuer frapper égorger buter cogner crever casser retrouver matar golpear apuñalar degollar romper partir reventar ammazzare uccidere picchiare matar bater vermoorden slaan убью убить зарежу сломаю",
    "suffer": "die rot suffer burn choke hang bleed drown perish sterben verrecken krepieren verrotten mourir crever souffrir morir morirte pudrirte sufrir morire crepare morrer sterven сдохни сдохнуть умри умрешь",
    "done": "gassed shot hanged hung killed beaten stabbed burned burnt lynched exterminated eradicated castrated sterilized sterilised raped whipped drowned deported executed slaughtered wiped caged vergast erschossen gehängt ausgerottet abgeschoben weggesperrt erschlagen gazés tués pendus expulsés éliminés enfermés fusilados ahorcados exterminados deportados gaseados expulsados gasati uccisi mortos vergast",
    "bare": "naked nude topless nackt desnudo desnuda desnudos desnudas nue nues nu nus nudo nuda pelado pelada naakt голую голая",
    "explicit": "nudes horny tits titties pussy boobs blowjob porn masturbate masturbating masturbation orgasm erection penis vagina nipples handjob dildo threesome fuckable nacktfotos nacktbilder geil titten ficken tetas follar follarte coño nichons baiser bander scopare tette gostosa neuken tieten сиськи трахнуть",
    "intimate": "sex sexy ass cock dick hot naughty wet body breasts butt thighs lips bed körper brüste hintern corps fesses seins culo pechos cuerpo corpo seni lichaam",
    "clothes": "shirt clothes top pants bra dress skirt blouse underwear panties trousers hemd kleidung bluse chemise vêtements culotte camisa ropa bragas vestiti roupa kleren",
    "hate": "hate hates hated despise despises loathe loathes detest detests abhor hasse hassen verachte verachten hais déteste détestons haïssons odio odiamos detesto odeio haat ненавижу ненавидят",
    "exclude": "throw kick chase drive deport ban expel remove lock wipe purge exclude send banish rauswerfen abschieben wegsperren ausweisen verjagen chasse chasser virer expulser renvoyer enfermer echar expulsar deportar encerrar cacciare expulsar uitzetten выгнать",
    "body": "finger fingers neck leg legs arm arms bone bones face nose hand hands teeth jaw skull knee knees throat head ribs kneecaps eyes genick hals beine arme gesicht nase zähne knochen finger cou jambes bras doigts dents gueule figure cuello piernas brazos dedos cara dientes huesos collo gambe dita pescoço pernas dedos nek benen шею ноги руки пальцы",
    "you": "you u ya yourself yourselves ye you're youre you've you'll you'd y'all thou du dich dir euch ihr tu te toi vous t'es eres sos usted ustedes vosotros ti te contigo sei tu voi você voce tu vocês jij je jou jullie ты тебя тебе вы вас тобой",
    "your": "your yours ur dein deine deinen deiner deinem euer eure ton ta tes votre vos tus tu vuestra vuestro tuo tua tuoi teu tua seu sua jouw твой твоя твою твои тебе",
    "i": "i i'm i'll i'd i've we we'll we're we'd someone somebody gonna ich wir jemand je j'ai nous on yo nosotros alguien io noi eu nós ik wij я мы",
    "me": "me us mir mich uns moi nous mí conmigo mig ci mim mij мне меня",
    "they": "he she they he's she's they're these those them him her guy dude guys this er sie die diese il elle ils elles ces ceux él ella ellos ellas esos esas esa ese lui lei loro ele ela eles zij он она они эти",
    "people": "people folk folks women woman men girls foreigners foreigner migrants migrant immigrants immigrant refugees refugee believers jews jew muslims muslim christians christian hindus gays gay lesbians queers trans homosexuals blacks black whites asians arabs mexicans africans gypsies roma disabled elderly old race races minority minorities tribe leute menschen frauen ausländer flüchtlinge migranten juden muslime schwarze schwule behinderte türken gens femmes étrangers immigrés migrants réfugiés juifs musulmans noirs arabes homosexuels gente mujeres extranjeros inmigrantes refugiados judíos musulmanes negros moros homosexuales gays persone donne stranieri immigrati ebrei musulmani pessoas mulheres estrangeiros imigrantes judeus mensen vrouwen buitenlanders vluchtelingen joden люди женщины мигранты евреи чурки",
    "person": "colleague author reviewer maintainer developer dev boss manager intern teammate team kid lady girl boy man woman kollege autor chef collègue auteur colega autor jefe person guy dude idiot",
    "be": "are is am be was were been being aren't isn't bist seid ist sind es est êtes sont eres es son sois sei sono siete são está bent zijn being",
    "should": "should must ought deserve deserves need needs hope hopes wish wishes shall gotta better sollte sollten soll gehört gehören verdienst verdienen muss müssen hoffe hoffentlich devrait devraient devrais mérites méritent espère deberían debería deben mereces merecen ojalá espero dovrebbero meriti deveriam mereces moeten должны заслуживаешь надеюсь",
    "wh": "what which who welcher was quel quelle qué cual che qual welke какой",
    "self": "i'm im myself",
    "code": """parser cache code codes test tests build builds script query queries handler module modules process processes job jobs server servers client clients thread threads worker workers function
functions method class file files line lines branch branches commit commits variable pointer pointers return returns value values bug bugs error errors request requests response responses pipeline queue
table tables index config configuration node nodes container containers pod pods service services api endpoint loop regex string strings bracket brackets brace import imports module package packages
compiler linter formatter editor ide tool tools library libraries framework dependency dependencies database db schema migration log logs logger output input data field fields column columns row rows key keys
method methods object objects session sessions connection connections socket port task tasks timer timeout retry release releases version versions design name names idea ideas mode model layout page pages
element elements button buttons css html scheduler runner hook merge rebase mock mocks stub fixture check checks rule rules filter filters list lists word words term terms question questions answer comment comments
message messages text texts example examples typo typos mistake mistakes switch statement statements case cases branch exception exceptions dependency plugin plugins vm image images disk cluster clusters quote quotes
collector collection detector counter report reports rate rates policy proof tree domain option options flag flags ticket tickets issue issues review request pr change changes patch diff""",
    "thanks": "thanks thank thx please congrats awesome great rock rocks star hero legend love danke merci gracias",
    "dismiss": "shut stfu gtfo verschwinde verpiss dégage fresse klappe maul gueule cállate lárgate zitti vattene cala заткнись отвали пошел",
}
_IDIOMS = {
    "threat": r"\bkys\b|\b(?:burn|rot) in hell\b|\bgo (?:die|drown|rot)\b|\bkill your ?self\b|\b(?:nobody|no one|noone) (?:would|will|'d) (?:ever )?miss you\b|\b(?:world|we|everyone|everybody|team) (?:is|are|would be|'d be) better (?:off )?without you\b|\bdisappear for good\b|\bwaste of (?:air|oxygen|skin|space|breath)\b|\b(?:find out|know|knows|found out) where you(?: and your \w+)? (?:live|sleep)\b|\bwatch your back\b|\bmake you (?:regret|pay|suffer|cry|bleed|sorry)\b|\byou(?:'ll| will| are going to) (?:regret|be sorry|pay for)\b|\b(?:put|stick) a (?:bullet|knife) in\b|\bend your (?:miserable )?life\b|\bnever have been born\b|\b(?:i|we)(?:'ll| will| am| are)? (?:come|coming) (?:for|after) you\b|\b(?:jump off a|hang yourself|slit your|drink bleach)\b"
    r"|\bwo du wohnst\b|\bbring(?:e)? dich um\b|\b(?:mach|schlag)e? dich (?:fertig|kaputt|tot)\b|\bou tu (?:habites|vis)\b|\bva (?:te pendre|mourir|crever)\b|\bdonde vives\b|\bte voy a (?:matar|romper|encontrar|partir|reventar)\b|\bdove abiti\b|\bwaar je woont\b|\bгде ты живешь\b|\bубей себя\b",
    "sexual": r"\b(?:take|get) (?:off )?your (?:\w+ )?(?:shirt|clothes|top|pants|bra|dress|skirt|blouse|underwear)\b(?: off)?|\b(?:sleep|sex|bed) with (?:me|you|her|him|us)\b|\b(?:had|have|having|want|wants) (?:\w+ )?sex\b|\bsuck my\b|\bsit on my (?:lap|face)\b|\bin my bed\b|\bget (?:in|into) (?:my|your) (?:bed|pants)\b|\bfuck (?:me|you (?:hard|all night|on))\b"
    r"|\bzieh dich aus\b|\bschlaf mit mir\b|\bcoucher avec (?:moi|toi)\b|\bdeshabille[ -]toi\b|\bdesnudate\b|\bacuestate conmigo\b|\bspogliati\b|\bтрахни\b|\bраздевайся\b",
    "dismiss": r"\bshut (?:the fuck )?up\b|\bget lost\b|\bgo to hell\b|\bcrawl back\b|\bpiss off\b|\bfuck (?:off|you|yourself)\b|\bscrew you\b|\bnobody asked you\b|\bhalt (?:die|deine) (?:dummheit )?(?:klappe|fresse)\b|\bhalt(?:'s|s)? maul\b|\bverschwinde\b|\bverpiss dich\b|\bferme[ -]la\b|\bta gueule\b|\bdegage\b(?! ?[-_./])|\bcasse[ -]toi\b|\bcallate\b|\bvete a la\b|\blargate\b|\bnadie te pregunto\b|\bvai inferno\b|\bcala a boca\b|\bhou je (?:bek|mond)\b|\bзаткнись\b|\bотвали\b|\bпошел (?:ты|вон)\b",
    "demean": r"\b(?:nobody|noone) (?:likes|loves|wants|needs|respects) (?:you|people like you)\b|\bno one (?:likes|loves|respects) (?:you|people like you)\b|\bno sirves para nada\b|\btu ne sers a rien\b|\bdu bist nichts wert\b|\byou people disgust\b|\byou (?:make me sick|disgust me)\b|\btoo (?:stupid|dumb|fat|ugly|lazy) to (?:breathe|live|exist|read|think|count)\b",
    "hate": r"\b(?:none|not one|no one) of (?:them|these people|those people) belongs?\b|\bgo back to (?:your|their) (?:own )?countr(?:y|ies)\b|\bsend (?:them|you) back (?:to|where)\b|\bqu'on les (?:chasse|vire|enferme|expulse)\b|\bno deberian? (?:vivir|estar|existir) aqui\b|\bgehoren (?:weggesperrt|abgeschoben|vergast|weg)\b|\b(?:should|must) not be allowed to (?:touch|vote|live|work|exist|breed|speak)\b",
}


def _forms(role: str, word: str) -> Iterator[str]:
    """A word with the endings of its role."""
    yield word
    if role == "insult":
        yield from (word + e for e in ("s", "es", "n", "e", "en"))
    elif role == "weak":
        yield word + "s"
    elif role == "violence" and word.isascii():
        yield from (word + "s", word + "ing", word + "ed")


def _roles() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for role, said in ROLES.items():
        for w in said.split():
            for x in _forms(role, fold(w)):
                out.setdefault(x, set()).add(role)
    return {w: frozenset(r) for w, r in out.items()}


#: Letters that a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "v": "vu",
}
STARS = "*#%_"
#: Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans("авсеһіјкмнорԛѕтухуԁɡӏαβεικνορτυχγοАВСЕНІЈКМОРЅТХУ", "abcehijkmhopqstyxydglabeikvoptuxyoABCEHIJKMOPSTXY")
_ZERO = re.compile("[­​-‏⁠-⁤️﻿]")
_FOLD = {"ß": "ss", "’": "'", "ø": "o", "ł": "l"}

COST_SIGN, COST_STAR, COST_REPEAT, COST_DROP, COST_SWAP = 1.5, 2.6, 0.4, 0.25, 4.0
#: Cost of choosing a word of the lexicon at all.
PRIOR = 6.0
#: The same where a star hides letters: a star within a word has hardly another reading.
PRIOR_STARRED = 2.0

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]([ .\-_~|/·]))(?:[^\W_]\1){1,}[^\W_](?![^\W_])")
_SIGNED = re.compile(r"(?<![^\W])[^\W\d_]?[^\W_]*[0-9@$!|*#+€£%][\w@$!|*#+€£%]*[^\W_](?![^\W_])|(?<!\w)[0-9@$][^\W_]*[^\W\d_][^\W_]*|(?<![\w*])[^\W\d_]{2,}\*+(?![\w*])")
_REPEATED = re.compile(r"\b[^\W\d_]*([^\W\d_])\1\1+[^\W\d_]*\b")
_WORD = re.compile(r"[^\W\d_]+")
_BLANKS = re.compile(r"\S+")
MEMO_TOKENS = 300_000
#: Longest token that is read letter by letter; the words of harm are sought in longer ones all the same.
MAX_OPEN = 24


_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]+")
_ALIKE = re.compile(r"\w*[" + "".join(map(chr, LOOKALIKE)) + r"]\w*")
_RARE = re.compile("[" + _ZERO.pattern[1:-1] + "Â-ß\u0080-\u009f€" + "".join(map(chr, LOOKALIKE)) + "]")
_LATIN = re.compile("[A-Za-z]")


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, no accents, no invisible characters.

    A word with letters of two scripts is read as Latin; words wholly in another script stay.
    """
    if text.isascii():
        return text.lower()
    if _RARE.search(text):
        text = _ZERO.sub("", repaired(text))
        text = _ALIKE.sub(lambda m: m[0].translate(LOOKALIKE) if _LATIN.search(m[0]) else m[0], text)
    for c, plain in _FOLD.items():
        text = text.replace(c, plain)
    return _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()


SYMBOLS = 29  # space, a to z, digit, other


_CODES = bytes(c - 96 if 97 <= c <= 122 else 27 if 48 <= c <= 57 else 0 if c in b" \n\t\r" else 28 for c in range(256))


def symbols(text: str) -> np.ndarray:
    """Symbols of a folded text: 0 blank, 1 to 26 letters, 27 digit, 28 any other sign."""
    return np.frombuffer(text.encode("ascii", "replace").translate(_CODES), np.uint8).astype(np.int32)


def character_model(texts: DataFrame) -> list[int]:
    """Trigram counts over all texts: a table of SYMBOLS ** 3 numbers, whatever the corpus size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            x = symbols(fold(" ".join(t for t in batch.column(0).to_pylist() if t)))
            if len(x) > 2:
                total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    table = texts.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = [0] * SYMBOLS**3
    for r in table.collect():  # at most SYMBOLS ** 3 rows
        counts[r["gram"]] = r["n"]
    return counts


ROLE = _roles()
#: Roles one of which every frame and idiom needs; sentences without any score 0.
HARM = frozenset("insult weak demean dehuman violence suffer done explicit bare intimate clothes hate exclude dismiss".split())
#: Words of the idioms that stand in no harmful role.
IDIOM_WORDS = frozenset("kys back allowed chasse country countries die drown rot mourir crever disappear bullet knife born jump yourself drink wohnst dich habites vis pendre vives matar romper encontrar partir reventar voy abiti woont живешь себя sex suck sit fuck zieh schlaf coucher deshabille desnudate acuestate spogliati трахни раздевайся lost hell crawl piss screw halt halts maul ferme ta casse vete nadie inferno boca hou отвали вон sirves sers nichts sick disgust belong belongs enferme expulse vire deberia deberian gehoren breed vote".split())
#: Those of idioms that name a person.
IDIOM_WORDS_AIMED = frozenset("cry come coming miss without live sleep watch regret pay suffer sorry nobody noone likes loves respects".split())
LEXICON = sorted(w for w in ROLE if w.isalpha())
PLAIN = frozenset(LEXICON)
_KEEN = frozenset("touch kiss lick fuck bang undress spank grope caress kussen anfassen embrasser lecher besar tocar lamer chupar baciare toccare beijar".split())
#: Roles that do harm only to someone named in the sentence.
AIMED = frozenset("violence suffer done clothes intimate exclude".split())
_AIMED = frozenset(w for w, r in ROLE.items() if r & AIMED) | IDIOM_WORDS_AIMED | _KEEN
_AIM = frozenset(w for w, r in ROLE.items() if r & {"you", "your", "people", "me"}) | {"my", "her", "him"}
_ALONE = frozenset(w for w, r in ROLE.items() if r & (HARM - AIMED)) | IDIOM_WORDS


def worth(words: Iterable[str]) -> bool:
    """Whether a text of these words can have any feature."""
    words = set(words)
    return not _ALONE.isdisjoint(words) or not _AIMED.isdisjoint(words) and not _AIM.isdisjoint(words)


#: Look-alike, spaced and broken spellings are decoded to words that can do harm or aim it; short words only where they can't be anything else.
DECODED = sorted(w for w, r in ROLE.items() if w.isalpha() and len(w) > 2 and r & ((HARM - {"weak"}) | {"you", "your", "people"}))


LONGEST = max(map(len, DECODED))
#: Of equally likely words nouns for persons come first.
RANK = {w: 0 if "insult" in ROLE[w] else 1 if not ROLE[w].isdisjoint(("demean", "explicit", "dehuman", "intimate", "bare")) else 2 for w in DECODED}


class Decoder:
    """Viterbi decoding of disguised tokens against the words with roles and the character model."""

    def __init__(self, counts: list[int]):
        grams = np.array(counts, float).reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.1
        self.costs = -np.log(grams / grams.sum(axis=2, keepdims=True))
        self.trie: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        for w in DECODED:
            node = 0
            for c in w:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                node = self.trie[node][c]
            self.word[node] = w
        self.letters = {"".join(sorted(w)) for w in DECODED if len(w) > 3}
        self.restored = lru_cache(200_000)(self._restored)
        self.memo: dict[str, str] = {}

    def literal(self, token: str) -> float:
        """Cost of the token as it stands."""
        x = symbols(" " + token + " ")
        digits = sum(c.isdigit() for c in token)
        return float(self.costs[x[:-2], x[1:-1], x[2:]].sum()) + digits * math.log(10)

    def _restored(self, token: str) -> str | None:
        """The lexicon word that the token disguises, or None."""
        best = {0: 0.0}  # trie node -> cost
        trie = self.trie
        before: dict[int, float] = {}
        for k, o in enumerate(token):
            new: dict[int, float] = {}
            options = [(o, 0.0)] if o.isalpha() else []
            options += [(c, COST_SIGN) for c in STANDS_FOR.get(o, "") if c != o]
            star = o in STARS
            for node, cost in best.items():
                if star:
                    for _, to in trie[node].items():
                        if cost + COST_STAR < new.get(to, 1e9):
                            new[to] = cost + COST_STAR
                for c, extra in options:
                    to = trie[node].get(c)
                    if to is not None and cost + extra < new.get(to, 1e9):
                        new[to] = cost + extra
                if k and o == token[k - 1] and not star and cost + COST_REPEAT < new.get(node, 1e9):
                    new[node] = cost + COST_REPEAT
                if o in " .-_~|/·'" and cost + COST_DROP < new.get(node, 1e9):
                    new[node] = cost + COST_DROP
            if k and o.isalpha() and token[k - 1].isalpha() and o != token[k - 1]:
                for node, cost in before.items():  # the two were swapped
                    mid = trie[node].get(o)
                    to = trie[mid].get(token[k - 1]) if mid is not None else None
                    if to is not None and cost + COST_SWAP < new.get(to, 1e9):
                        new[to] = cost + COST_SWAP
            before, best = best, new
            if not best and not before:
                return None
        ends = [(cost, RANK[self.word[node]], self.word[node]) for node, cost in best.items() if node in self.word]
        if not ends or not any(map(str.isalpha, token)):
            return None
        cost, _, word = min(ends)
        return word if cost + (PRIOR_STARRED if "*" in token else PRIOR) < self.literal(token) else None

    def _open(self, token: str) -> str | None:
        """The likeliest letters of a token whose signs all stand for letters, or None where the literal reading is likelier."""
        if len(token) > MAX_OPEN or sum(map(str.isalpha, token)) < 2:
            return None
        best = {(0, 0): (0.0, "")}  # the last two symbols -> cost and letters
        for k, o in enumerate(token):
            options = [(o, 0.0)] if "a" <= o <= "z" else [(c, COST_SIGN) for c in STANDS_FOR.get(o, "")]
            if not options:
                return None
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, said) in best.items():
                for c, extra in options:
                    x = ord(c) - 96
                    total = cost + extra + self.costs[a, b, x]
                    if total < new.get((b, x), (1e9, ""))[0]:
                        new[b, x] = (total, said + c)
            best = new
        cost, said = min((cost + self.costs[a, b, 0], said) for (a, b), (cost, said) in best.items())
        return said if cost + PRIOR < self.literal(token) else None

    def _token(self, token: str) -> str:
        """A token between blanks with disguised words written plainly."""
        swap = lambda m: self.restored(m[0]) or self._open(m[0]) or m[0]
        out = _REPEATED.sub(swap, _SIGNED.sub(swap, token))
        return _WORD.sub(lambda m: (self.restored(m[0]) or m[0]) if m[0] not in PLAIN and "".join(sorted(m[0])) in self.letters else m[0], out)

    def _spaced(self, m: re.Match) -> str:
        """A row of parted letters; one-letter words at its ends may not belong to it."""
        row = m[0]
        for cut_off in (0, 2, 4):
            for at in range(0, cut_off + 1, 2):
                part = row[at : len(row) - cut_off + at]
                if len(part) > 4 and (word := self.restored(part)):
                    return row[:at] + word + row[len(row) - cut_off + at :]
        out, at = [], 0  # several words in a row: the longest that begins at each letter
        while at < len(row):
            for size in range(min(2 * LONGEST, len(row) - at + 1), 5, -2):
                if word := self.restored(row[at : at + size - 1]):
                    out.append(word + row[at + size - 1 : at + size])
                    at += size
                    break
            else:
                out.append(row[at : at + 2])
                at += 2
        return "".join(out)

    def restore(self, text: str) -> str:
        """The folded text with disguised lexicon words written plainly.

        Each distinct token is decoded once; the memo changes speed only.
        """
        text = _SPACED.sub(self._spaced, fold(text))
        changed, memo = {}, self.memo
        for t in set(text.split()):
            out = memo.get(t)
            if out is None:
                out = self._token(t)
                if len(memo) >= MEMO_TOKENS:
                    memo.clear()
                memo[t] = out
            if out is not t and out != t:
                changed[t] = out
        return _BLANKS.sub(lambda m: changed.get(m[0], m[0]), text) if changed else text


_MENTION = re.compile(r"\b(?:word ?lists?|block ?lists?|deny ?lists?|filters?|banned words?|swear ?words?|the words?|the terms?|code of conduct|policy|policies|lexicon|moderation|profanity|rules?|wortliste|filtre|filtro|phrases? (?:like|such as))\b")
_QUOTED = re.compile(r"[\"'`“„«‘][^\"'`”“»’]{1,40}[\"'`”“»’]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n|\r")


FEATURES = ("threat", "hate", "sexual", "insult", "demean", "contempt", "dismiss", "loose")
#: Weights before any label is seen (the bias first); the fit is drawn to them.
PRIOR_WEIGHTS = (-4.6, 7.6, 7.2, 7.2, 6.4, 5.9, 5.6, 2.0, 0.8)
#: Labels' worth of evidence that the weights above stand for.
PRIOR_STRENGTH = 4.0

#: Words, names joined by signs (code, never read as words) and the signs that end or part sentences.
_PIECE = re.compile(r"\w+(?:[./\\]\w+)+|[^\W\d_]+(?:'(?:re|s|ll|ve|d|m|t|all)\b)?|[.!?;:,()\"]")
_IDIOM = {k: re.compile(v) for k, v in _IDIOMS.items()}
_NONE: frozenset[str] = frozenset()
#: Verbs whose object comes before them.
_OBJECT_FIRST = frozenset("tuer frapper egorger buter cogner crever casser retrouver umbringen erschlagen verprugeln vergasen toten schlagen".split())
_STOPS = frozenset(".;:!?")
_NOT = frozenset("not never don't won't didn't doesn't wouldn't can't cannot nicht nie ne pas jamais no nunca non не".split())
_FUNCTION = frozenset("and or but who that of to so for in on at like as if because when while with without you he she they und oder aber der die das et ou mais qui de que y o pero e il la lol".split())
_GENERIC = frozenset(map(fold, "people folk folks leute menschen gente gens persone pessoas mensen люди race tribe".split()))
_OUT = frozenset("out away back off raus weg dehors fuera via".split())
_PICTURES = frozenset("picture pictures pics pic photo photos selfie selfies video videos foto fotos bild bilder".split())
_CURVES = frozenset("breasts butt thighs bruste fesses seins pechos seni culo".split())


def _words_between(t: list[str], a: int, b: int) -> bool:
    return _STOPS.isdisjoint(t[a:b])


def frames(s: str) -> int:
    """The features of one restored sentence, as bits in the order of FEATURES.

    A harmful word counts by what it is said of: its subject and object are looked
    for around it, up to the next stop. Words that qualify a thing ("failure
    handler"), that are said of oneself or denied do not count.
    """
    t = _PIECE.findall(s)
    n = len(t)
    r = [ROLE.get(w, _NONE) for w in t]
    hit = {k for k, p in _IDIOM.items() if p.search(s)}
    near = lambda role, a, b: any(role in r[k] for k in range(max(0, a), min(n, b)))
    you_in, group_in = near("you", 0, n), near("people", 0, n)

    def thing(k: int) -> bool:
        return k + 1 < n and "code" in r[k + 1]

    def denied(k: int) -> bool:
        return not _NOT.isdisjoint(t[max(0, k - 5) : k])

    def group(k: int) -> bool:
        """A group of people: named, or people with a determiner or an origin."""
        if "people" not in r[k]:
            return False
        return t[k] not in _GENERIC or near("they", k - 2, k) or near("people", k - 1, k) or near("you", k - 1, k) or k + 1 < n and t[k + 1] in ("from", "like", "de", "aus", "wie")

    def said_of(role: str, k: int, reach: int = 6) -> bool:
        """Whether a subject of the role and a form of be stand before place k."""
        for b in range(max(0, k - reach), k):
            fused = role == "you" and t[b] == "you're" or role == "they" and t[b] in ("he's", "she's", "they're")
            if (fused or "be" in r[b] and (near(role, b - 3, b) or near(role, b + 1, b + 2))) and _words_between(t, b, k):
                if not fused and role in ("they", "person") and near("code", b - 2, b):
                    continue
                return True
        return False

    def own(k: int) -> bool:
        """Whether the word at k is said of the one who writes."""
        for b in range(max(0, k - 6), k):
            if ("self" in r[b] or "i" in r[b] and t[b] not in ("we", "someone", "somebody")) and (t[b] in ("i'm", "im", "myself") or near("be", b + 1, b + 3) or b + 1 < n and t[b + 1] in ("feel", "felt", "look", "fuhle")) and not near("you", b + 1, k):
                return True
        return False

    for k in range(n):
        roles = r[k]
        if not roles or HARM.isdisjoint(roles):
            continue
        if "violence" in roles and not denied(k):
            agent = near("i", k - 8, k) or near("they", k - 4, k) or near("should", k - 6, k) or k == 0
            for j in range(k + 1, min(n, k + 5)):
                if t[j] in _STOPS or "code" in r[j]:
                    break
                if "you" in r[j] and agent:
                    after = t[j + 1] if j + 1 < n else ""
                    if after not in ("to", "some", "a", "an", "any") and not (j + 1 < n and "code" in r[j + 1]):
                        hit.add("threat")
                    break
                if "your" in r[j]:
                    if near("body", j + 1, j + 3) and (agent or you_in):
                        hit.add("threat")
                    break
                if "body" in r[j] and you_in and agent:
                    hit.add("threat")
                if group(j) and agent:
                    hit.add("threat")
                    break
            if t[k] in _OBJECT_FIRST and near("you", k - 6, k) and near("i", k - 8, k):
                hit.add("threat")
        if "suffer" in roles and not denied(k) and near("should", k - 8, k) and (near("you", k - 6, k) or any(group(j) for j in range(max(0, k - 6), k))) and not near("code", k - 3, k):
            hit.add("threat")
        if "done" in roles and not denied(k) and (near("should", k - 6, k) or near("be", k - 3, k) and near("should", k - 8, k)) and (near("you", k - 8, k) or any(group(j) for j in range(max(0, k - 8), k))) and not thing(k):
            hit.add("threat")
        if "dehuman" in roles and not thing(k):
            if any(group(j) and near("be", j + 1, k) for j in range(max(0, k - 7), k)) or said_of("they", k) or said_of("you", k):
                hit.add("hate")
            elif t[k] not in ("animals", "beasts", "pests", "savages", "parasites", "ratas", "cafards", "filth", "scum", "parasiti", "parasiten") and any("be" in r[b] and not near("code", b - 1, b) and _words_between(t, b, k) for b in range(max(0, k - 5), k)):
                hit.add("hate")
        if not roles.isdisjoint(("insult", "demean", "weak")) and not thing(k) and any(group(j) and near("be", j + 1, k) and _words_between(t, j, k) for j in range(max(0, k - 8), k)):
            hit.add("hate")
        if "hate" in roles:
            for j in range(k + 1, min(n, k + 5)):
                if t[j] in _STOPS or "code" in r[j]:
                    break
                if group(j):
                    hit.add("hate")
                if j == k + 1 and "you" in r[j] and not near("code", j + 1, j + 2) and not denied(k):
                    hit.add("contempt")
            if k and "you" in r[k - 1] and near("i", k - 3, k - 1) or k >= 1 and t[k] in ("hasse", "hassen", "verachte") and near("you", k + 1, k + 2):
                hit.add("contempt")
        if "exclude" in roles and (group_in or "hate" in hit or near("dehuman", 0, n)):
            for j in range(k + 1, min(n, k + 6)):
                if t[j] in _STOPS or "code" in r[j]:
                    break
                if t[j] in _OUT and (any(group(m) for m in range(k + 1, j)) or near("dehuman", 0, n)):
                    hit.add("hate")
                if "people" in r[j] and t[k] in ("deport", "expel", "banish", "abschieben", "wegsperren", "ausweisen", "deportar", "expulsar", "expulser"):
                    hit.add("hate")
        if "explicit" in roles and not thing(k) and (you_in or near("your", 0, n) or near("me", 0, n) or near("i", 0, n) or near("they", 0, n) or near("person", 0, n)):
            hit.add("sexual")
        if "bare" in roles and not thing(k) and (any((not r[j].isdisjoint(("you", "your", "me")) or t[j] in ("her", "him")) and _words_between(t, min(j, k), max(j, k)) for j in range(max(0, k - 4), min(n, k + 5))) or not _PICTURES.isdisjoint(t[max(0, k - 3) : k + 2])):
            hit.add("sexual")
        if "intimate" in roles and not thing(k) and (t[k] == "sexy" and (you_in or near("your", 0, n)) or t[k] in _CURVES and near("your", k - 2, k) or t[k] in ("hot", "ass", "body", "lips", "bed") and near("your", k - 2, k) and not _KEEN.isdisjoint(t)):
            hit.add("sexual")
        if "insult" in roles and not thing(k):
            before = range(max(0, k - 7), k)
            aimed = (
                any("you" in r[j] and _words_between(t, j, k) for j in before)
                or near("you", k + 1, k + 5) and _words_between(t, k, min(n, k + 4))
                or near("your", k - 7, k) and near("be", k - 5, k)
                or k + 2 < n and t[k + 1] in ("like", "wie", "comme", "como", "come") and ("you" in r[k + 2] or "they" in r[k + 2])
                or any("wh" in r[j] and _words_between(t, j, k) for j in range(max(0, k - 4), k))
                or said_of("they", k) or said_of("person", k)
                or k and t[k - 1] in ("pauvre", "fucking", "stupid", "dirty", "damn", "bloody", "bloder", "blode", "damlicher", "sale", "puto", "maldito")
                or any(t[j] in ("espece", "pedazo", "bande", "pezzo", "cacho") for j in range(max(0, k - 2), k))
                or k > 1 and t[k - 1] in ("ein", "eine", "n") and t[k - 2] == "so"
                or k > 1 and t[k - 2] == "only" and k + 1 < n and t[k + 1] in ("like", "would", "could")
                or "dismiss" in hit
                or k and t[k - 1] == "," and (k + 1 == n or t[k + 1] in _STOPS) and not near("insult", k - 3, k)
            )
            if own(k) or denied(k) and not near("you", k - 3, k):
                hit.add("loose")
            else:
                hit.add("insult" if aimed else "loose")
        elif not roles.isdisjoint(("weak", "demean")) and not own(k) and not denied(k):
            after = t[k + 1] if k + 1 < n else "."
            ends = not after[0].isalpha() or after in _FUNCTION or k + 1 < n and not r[k + 1].isdisjoint(("insult", "weak", "demean"))
            adjacent = k and ("you" in r[k - 1] or k > 1 and not r[k - 1].isdisjoint(("demean", "insult")) and near("you", k - 3, k))
            if "weak" in roles and "dismiss" in hit and ends and not thing(k):
                hit.add("insult")
            elif (said_of("you", k, 5) or adjacent) and not thing(k) and (ends or "demean" in roles and not after.endswith("ing")) and not near("code", k - 2, k):
                hit.add("demean")
            elif not thing(k):
                hit.add("loose")
    if not _KEEN.isdisjoint(t) and not denied(n):
        for k in range(n - 1):
            if t[k] in _KEEN and "you" in r[k + 1] and near("i", k - 6, k) and not near("code", k + 2, k + 3):
                hit.add("sexual")
    if sum("demean" in x for x in r) > 1 and ("typical" in t or any(group(j) for j in range(n))):
        hit.add("hate")
    return sum(1 << k for k, f in enumerate(FEATURES) if f in hit)


def score_of(mask: int, weights: list[float] | tuple[float, ...]) -> float:
    """Logistic score of a document's features; 0 without any."""
    if not mask:
        return 0.0
    z = weights[0] + sum(w for k, w in enumerate(weights[1:]) if mask >> k & 1)
    return round(1 / (1 + math.exp(-z)), 4)


def fitted(rows: list[tuple[int, float, int]]) -> list[float]:
    """Weights of a logistic model from (mask, labelled toxic, labelled) counts, drawn to PRIOR_WEIGHTS.

    Harmful features never count against a text: weights stay at or above 0.
    """
    prior = np.array(PRIOR_WEIGHTS)
    if not rows:
        return prior.tolist()
    x = np.array([[1.0, *(m >> k & 1 for k in range(len(FEATURES)))] for m, _, _ in rows])
    y, n = np.array([a for _, a, _ in rows], float), np.array([b for _, _, b in rows], float)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - n * p) - PRIOR_STRENGTH * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w)), grad)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return [round(float(v), 6) for v in w]


_LINE_MARK = re.compile(r"\n[ \t]*(?://+|\*+|#+|>+|--|;|\"\"\"|/\*+)?[ \t]*(?=\S)")


class Scorer:
    def __init__(self, counts: list[int]):
        self.decoder = Decoder(counts)

    def features(self, text: str | None) -> int:
        """Bits of the features that some sentence of the text has."""
        if not text or not text.strip():
            return 0
        restored = self.decoder.restore(text)
        if not worth(_WORD.findall(restored)):
            return 0
        # comment and quote marks at line starts, then line breaks inside sentences, do not matter
        restored = _LINE_MARK.sub(" ", restored)
        mask = 0
        for s in _SENTENCE.split(restored):
            if worth(_WORD.findall(s)):
                mask |= frames(_QUOTED.sub(" ", s) if _MENTION.search(s) else s)
        return mask

    def score(self, text: str | None, weights: list[float] | tuple[float, ...] = PRIOR_WEIGHTS) -> float:
        return score_of(self.features(text), weights)


def masks(docs: DataFrame, counts: list[int] | None = None) -> DataFrame:
    """``(doc_id, mask)`` of every row; the character model is counted over the same rows when not given."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(counts or character_model(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.features(t.as_py()) for t in batch.column(1)], pa.int32())], names=["doc_id", "mask"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mask int")


def weights_from(found: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[float]:
    """Weights fitted on the reviewers' marks of at most ``most`` documents; several marks of a document are averaged."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    by_mask = found.filter("doc_id IS NOT NULL").join(F.broadcast(marked), "doc_id").groupBy("mask").agg(F.sum("toxic").alias("y"), F.count("*").alias("n"))
    return fitted([tuple(r) for r in by_mask.collect()])  # at most 2 ** 8 rows


def scored(docs: DataFrame, labels: DataFrame | None = None, counts: list[int] | None = None) -> DataFrame:
    """``(doc_id, score)`` of every row, by weights fitted on the labels where there are any."""
    found = cut(masks(docs, counts))
    weights = list(PRIOR_WEIGHTS) if labels is None else weights_from(found, labels)
    table = F.array(*(F.lit(score_of(m, weights)) for m in range(1 << len(FEATURES))))
    return found.select("doc_id", table[F.col("mask")].alias("score"))


def rates(docs: DataFrame, scores: DataFrame, least: float = FOUND_FROM) -> DataFrame:
    """Per source: documents, flagged documents and their share. A null source is its own row."""
    hit = (F.col("score") >= least).cast("long")
    return docs.select("doc_id", "source").join(scores, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.sum(hit).alias("flagged"), F.round(F.avg(hit), 6).alias("rate"))
