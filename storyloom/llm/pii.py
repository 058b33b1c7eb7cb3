"""Personal information inside free text (problem 2).

High-recall generators propose overlapping spans of five types: anything like an e-mail, every longer number, every
street with a number or box, and as names every run of capitalised words in any script with capitals, every pair of
words out of the vocabulary, and what stands where scripts without capitals name a person. Boosted trees score each
span by format and context features; thresholds calibrated on sentences of frames the trees have not seen select, and
of overlapping spans the surest wins. The trees are fitted on labelled sentences made by the grammar in ``pii_train``
(bounded: ``pii_train.ROWS`` sentences). Which words are common, and which are only known with a capital, is read
from the vocabulary files of public tokenizers.
"""

from __future__ import annotations

import base64
import importlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.boost import Boosted

TYPES = ["email", "phone", "id_number", "address", "person"]

#: Times a candidate that is none counts in calibration: texts hold far more capitalised words than names.
NEGATIVES = {"person": 5}
#: Vocabulary files (names of the installed tokenizer package, or paths).
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

# Cue words of each kind (matched as word beginnings, any case).
CUES = {
    "id": "social security|social|ssn|passport|pasaporte|passnummer|reisepass|passeport|passaporte|licen[cs]e|permis|führerschein|visa|tax|steuer|dni|nie|nif|cpf|cnh|rg|ni number|national|insurance number|sécurité sociale|identity|identidad|identidade|ausweis|personalausweis|carte d'identité|carteira|curp|aadha+r|codice fiscale|паспорт|инн|снилс|身份证|护照|パスポート|マイナンバー|आधार|पासपोर्ट|جواز|الهوية",
    "phone": "call|phone|cell|mobile|tel|text|dial|ring|rang|reach|number on|nummer|numéro|número|rief|rufen|anruf|appel|llam|telefon|teléfono|ligar|ligue|fax|whatsapp|телефон|звон|номер|电话|手机|電話|전화|फ़ोन|هاتف|اتصل|โทร|เบอร์",
    "thing": "lot|order|serial|case|file|room|version|season|score|invoice|ticket|bus|model|item|part|points|isbn|flight|train|engine|crate|batch|tracking|receipt|page|chapter|los|pedido|commande|bestell|rechnung",
    "home": "liv|live|lived|moved|address|mail|grew up|house|home|apartment|flat|wohn|zog|umgezogen|habit|déménag|adresse|viv|mud|mora|domicil|dirección|endereço|abit|woon|mieszka|жил|живу|адрес|住|地址|住所|पता|عنوان",
}
_CUE = re.compile("|".join(rf"(?P<{k}>(?<![^\W\d_])(?:{v}))" for k, v in CUES.items()), re.I)
_CUE_CODE = {"id": 1, "phone": 2, "thing": 3, "home": 4}

# Titles, common given names (a feature, not a filter), and names that are words as well.
TITLES = set("dr mr mrs ms mx miss prof professor professora doctor herr herrn frau mme mlle monsieur madame maître sr sra srta dra don doña señor señora dona senhor senhora sir sister father officer coach nurse judge captain uncle aunt tante onkel tía tío tia tio m signora signor mevrouw meneer pan pani доктор господин госпожа".split())
GIVEN = set(
    """james john robert michael david william richard joseph thomas charles daniel matthew anthony steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra margaret ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura sharon cynthia kathleen amy angela anna emma olivia sophia
    hans klaus jürgen wolfgang peter stefan andreas markus sabine petra monika ursula jean pierre michel philippe marie nathalie isabelle sophie émile josé juan carlos luis óscar ángela maría carmen ana lucía joão antónio pedro beatriz ivan dmitri olga natasha
    giulia marco luca jan kees anneke łukasz agnieszka šárka björn ahmed fatima omar zainab tunde ravi priya mei hiroshi yuki""".split()
)
WORD_NAMES = set("grace will hope mark faith joy rose bill frank dawn drew jack pat rob sue ray dean chase hunter iris ivy lily olive pearl ruby violet daisy heather amber crystal christian guy miles wade art".split())

# Words of closed classes and other words that tell about the words beside them, as "class: words".
_CLASSES = """
kin: señor señora senhor senhora signor signora madame monsieur doctor doctora cousin cousine primo prima kid uncle aunt brother sister neighbour neighbor friend colleague coworker roommate boss manager coach teacher nurse mentor landlord boyfriend girlfriend wife husband son daughter father mother dad mom grandfather grandmother classmate therapist student kollege kollegin freund freundin bruder schwester nachbar nachbarin chef lehrer lehrerin tante onkel ami amie frère soeur collègue voisin voisine professeur cuisine amigo amiga hermano hermana vecino vecina profesor profesora colega jefe irmão irmã vizinho vizinha professora chefe amico amica vriend vriendin kolega друг подруга брат сестра коллега тётя дядя
named: named name called heißt hieß heiße s'appelle s'appelait appelle appelait llama llamaba llamo chama chamava chamo chiama heet nazywa зовут
article: im am zum zur ins vom beim ans the a an my your his her its our their this that der die das den dem des ein eine einen einem einer mein meine meinen meinem meiner unser unsere sein seine ihr ihre kein keine le la les un une mon ma mes son sa notre leur el los las una mi su nuestro nuestra o os as um uma meu minha seu sua il lo gli mio mia het een mijn mój moja мой моя наш
place: in at near past toward towards around outside inside into across through between back aus nach bei von zwischen en près chez dans entre vers desde hacia em perto até de du da do в на из под w na z te naar
person: with for to from by like except as of mit für zu ohne avec pour par con para por com met phoned thanked visited trusted missed married remembered told asked blamed saw knew loved hired followed said thinks says traf fragte fragten sah vu vi hablé falei escrevi ho visto zag с и ask tell dear thanks regards sincerely
is: was is are were be am war ist sind c'était est était era es foi è был была
conj: and or und oder et ou y e i и but aber mais pero mas that when because if although dass weil que quand cuando quando then dann puis then here only there so also
pronoun: i you he she it we they who me him us them ich du er sie es wir je tu il elle nous vous ils yo tú él ella nosotros ele ela nós
time: monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december sept jan feb yesterday today tomorrow montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember
inst: st ste mt ft fort street avenue road lane court drive boulevard blvd ave bay clinic ridge festival mill hall school college university hospital church park river lake bridge station county city town village island mountain valley hill beach port saint san santa new old upper lower north south east west airport hotel museum library theatre stadium market garden club review mount
"""
CLASS = {w: k for k, line in enumerate(reversed(_CLASSES.strip().split("\n")), 1) for w in line.partition(":")[2].split()}
_KIN, _NAMED, _ARTICLE, _PLACE, _PERSON, _IS, _CONJ, _PRONOUN, _TIME, _INST = range(10, 0, -1)
VERB, CAPITAL, NUMERAL, EDGE = 11, 12, 13, 14
#: The classes in order of how much they speak for a name after, or before, them (0 is any other word).
AFTER_WORD = {k: r for r, k in enumerate((_PLACE, _INST, _ARTICLE, _TIME, NUMERAL, _PRONOUN, 0, CAPITAL, EDGE, _IS, _CONJ, VERB, _PERSON, _NAMED, _KIN))}
BEFORE_WORD = {k: r for r, k in enumerate((_INST, NUMERAL, _ARTICLE, _PLACE, 0, EDGE, CAPITAL, _TIME, _PERSON, _KIN, _CONJ, _NAMED, _IS, _PRONOUN, VERB))}
_IRREGULAR = set("came went stood helped knew wrote read sang ran held drove kept took found left got made gave cried won lost cut let put sat sold spoke told said saw thought bought brought began broke chose did had was has does is opened never would could will did lachte kam rief sagte ging hat öffnete rit venu disait parti est ouvrait llegó llamó dijo abrió vino quería riu chegou ligou disse abriu veio queria был сказал пришёл плакала".split())
#: Endings of a sentence's first word that is a verb, in languages that put it there.
_OWN_VERB = ("ó", "amos", "emos", "imos", "aba", "aban", "ía", "ían", "ava", "avam", "ei", "eu", "ou", "iu", "í", "é")
_VERB_ENDS = ("ed", "ait", "ó", "ou", "л", "ла")
#: Words that never begin a name, whatever their case.
# Words of moving (before a place) and of speaking, writing and giving (before a person).
MOVING = set("between zwischen entre walk walked walking went go going gone come came coming back drive drove driven way road trip travel moved move flew fly ran run return returned bus train miles far fled left arrived live lived ging fuhr reiste kam zurück weg reise zog nach allé venu parti retour route vers fui fue vino llegó viaje camino volvió fui foi veio chegou viagem caminho voltou поехали приехал вернулся".split())
SPEAKING = set("tell told write wrote say said speak spoke talk talked ask asked give gave letter thank thanks thanked show showed signed answer answered erzählt erzählte gesagt sagte schrieb gesprochen gab dit parlé écrit raconté répondu dije conté escribí hablé di disse contei escrevi falei dei сказал написал".split())
#: Both, and words of kin and naming, that stand near a candidate: (class, moving or speaking).
NEAR = {w: (CLASS.get(w, 0) if CLASS.get(w) in (_KIN, _NAMED) else 0, 1 if w in MOVING else 2 if w in SPEAKING else 0) for w in [*CLASS, *MOVING, *SPEAKING] if CLASS.get(w) in (_KIN, _NAMED) or w in MOVING or w in SPEAKING}
STOP = {w for w, k in CLASS.items() if k in (_ARTICLE, _PLACE, _IS, _CONJ, _PRONOUN, _NAMED, _TIME, _PERSON, _KIN)} - WORD_NAMES - {"may", "april", "june", "august"} | set("not no nobody what why how where did do does can could would please yes well okay his all some most many then there these those everyone everybody nothing something somebody someone dr prof int interviewer interviewee respondent participant answer question q r nr bd est-ce qu'est-ce".split())

_STAMP = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3}|-\d{1,2})?"
NOISE = re.compile(
    rf"[\[(<#]\s*{_STAMP}\s*[\])>#]|^\s*{_STAMP}(?: -)?(?=\s)|\s?(?:\(\([^()\n]{{0,40}}\)?\)|\((?!at\)|dot\))[a-z][a-z ]{{2,24}}\)|\[(?!at\]|dot\])[A-Za-z][^\]\n@]{{2,24}}\]|<[a-z ]{{3,16}}>|\*[a-z ]{{3,20}}\*|\{{[a-z ]{{3,24}}\}})(?=[\s.,!?])|(?<=[\s(])(?:u+h+m?|u+m+|e+r+m?|a+h+|h+m+|e+h|euh|ben|ähm?|este|hã|like|I mean|you know),?(?=\s)",
    re.M,
)
#: A text without any of these holds no noise.
_NOISE_HINT = re.compile(r"[(\[<#*{:]| (?:u+[hm]|er|ah|hm|eh|ben|äh|este|hã|like|I mean|you know|U[HM])", 0)

_ADDR_AT = r"(?:\s?\(at\)\s?|\s?\[at\]\s?|\s+at\s+|@)"
_ADDR_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s+dot\s+)"
EMAIL = re.compile(rf"[\w+\-]+(?:{_ADDR_DOT}[\w+\-]+)*{_ADDR_AT}[A-Za-z0-9\-]+(?:{_ADDR_DOT}[A-Za-z0-9\-]+)+", re.I)
_EMAIL_GATE = re.compile(r"@|[\[(]at[\])]|\sdot\s", re.I)
NUMBER = re.compile(r"(?<![\w.,/\-])(?:[A-Z]{1,2} (?=\d{6})|[A-Za-z]{1,3}-?(?=\d))?[+(]*\d(?:[ \-./()]{0,2}\d){4,17}(?:[ \-.]?[A-Za-z](?![A-Za-z]))?(?:,? ?(?:ext\.?|x|extension) ?\d{1,5})?(?![\w@])")
#: Two letters, six digits and a letter.
LETTERED = re.compile(r"(?<![\w\-])[A-Za-z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-Za-z](?!\w)")
_LETTERED_HINT = re.compile(r"\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-Za-z]")
#: Both of these hold such digits.
_DIGITS5 = re.compile(r"\d(?:[ \-./()]{0,2}\d){4}")
_W = r"[^\W\d_][\w’'.\-\x80-\xff\u0100-\u024f\u2010-\u203a\u20ac\u2122©]*"
_TAIL = _W[_W.index("]") + 1 :]
STREET_EN = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Drive|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Close|Crescent|Row|Parkway|Pkwy|Highway|Hwy|Circle|Trail|Alley|Mews"
STREET_SHORT = "St|Ave|Rd|Ln|Ct|Blvd|Pl|Sq|Pkwy|Hwy"
_STREETS = [
    rf"(?:(?:Unit|Apt\.?|Flat|Suite|No\.) ?\w{{1,5}}, )?\d{{1,5}}(?: ?[\-–] ?\d{{1,5}})?[A-Za-z]?,? (?:[NSEW]\.? )?(?:[A-Z]{_TAIL} ){{1,3}}(?:(?:{STREET_SHORT})\.|(?:{STREET_EN})\b)(?:,? (?:Apt|Unit|Suite|Flat|#)\.? ?\w{{1,5}})?",
    r"P\.? ?O\.? ?Box \d+|(?<!\w)(?:Postfach|Apartado(?: de [Cc]orreos)?|Caixa [Pp]ostal|C\.P\.|BP|B\.P\.|а/я|Casilla|GPO Box|PO Box|P\. ?O\. ?Box) \d[\d ]*|(?:^|(?<=[.!?] )|(?<=P\.O\. ))Box \d+",
    rf"(?:{_W} )?[A-ZÄÖÜ]{_TAIL}(?:straße|strasse|stra.{{1,3}}e|str\.|gasse|weg|allee|platz|ring|damm|ufer|hang|steig|pfad)[ \n]\d{{1,4}} ?[a-h]?\b|[A-ZÄÖÜ]{_TAIL} (?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm) \d{{1,4}} ?[a-h]?\b|(?:Am|An der|An dem|Im|Zum|Zur|Auf der|Auf dem|In der|Unter den) [A-ZÄÖÜ]{_TAIL} \d{{1,4}} ?[a-h]?(?=[ ,.\n]|$)",
    rf"\d{{1,5}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|impasse|allée|all.{{1,4}}e|quai|route|cours|square|passage|sentier) {_W}(?: {_W}){{0,3}}",
    rf"(?<!\w)(?:[Cc]alle|C/|[Aa]vda?\.|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Cc]arrera|[Rr]onda|[Cc]arretera) (?:{_W},? ){{1,4}}?(?:n\.?[º°] ?|n.{{1,3}}|núm\. )?\d{{1,5}}\b",
    rf"(?<!\w)(?:[Rr]ua|[Aa]v\.|[Aa]venida|[Tt]ravessa|[Pp]raça|[Aa]lameda|[Ee]strada|[Ll]argo|[Rr]odovia) (?:{_W},? ){{1,4}}?(?:n\.?[º°] ?)?\d{{1,5}}\b",
    rf"(?<!\w)(?:ул\.?|улиц[аеуы]|пр\.|пр-т|проспект\w?|пер\.|переул\w+|бульвар\w?|шоссе|наб\.) [\w\-]+(?: [\w\-]+)?,? (?:д(?:ом|\.)? ?)?\d{{1,4}}",
    rf"(?<!\w)(?:[Vv]ia|[Pp]iazza|[Cc]orso|[Vv]iale|[Vv]icolo) (?:{_W},? ){{1,4}}?\d{{1,4}}\b",
    rf"[A-Z]{_TAIL}(?:straat|laan|gracht|kade|plein|dijk|singel|weg)[ \n]\d{{1,4}} ?[a-h]?\b",
    rf"(?<!\w)(?:ul\.|ulic[aeęy]|al\.|alej[aei]|pl\.|os\.) {_W}(?: {_W})?,? \d{{1,4}}(?:/\d{{1,4}})?\b",
    r"[\u4e00-\u9fff]{1,8}(?:路|街|大道|巷)\s?\d+\s?(?:号|號)|[\u4e00-\u9fff\u30a0-\u30ff]{1,8}(?:町|丁目)\s?\d[\d\-－]*",
]
ADDRESS = [re.compile(p) for p in _STREETS]
#: Per pattern, words without one of which it can't match.
_STREET_HINTS = [
    (),  # by _AFTER_NUMBER
    ("Box", "Postfach", "Apartado", "aixa", "C.P.", "BP ", "B.P.", "а/я", "Casilla"),
    ("stra", "Am ", "An d", "Im ", "Zum", "Zur", "Auf d", "In der", "Unter den", " Straße", " Str."),
    (),  # by _AFTER_NUMBER
    ("alle ", "C/", "vda", "venida", "laza", "aseo", "amino", "arrera", "onda ", "arretera"),
    ("ua ", "v. ", "venida", "ravessa", "raça", "lameda", "strada", "argo ", "odovia"),
    ("ул", "пр", "пер", "бульвар", "шоссе", "наб"),
    ("ia ", "iazza", "orso", "iale", "icolo"),
    ("\0",),
    ("ul.", "ulic", "al.", "alej", "pl.", "os."),
    ("号", "號", "町", "丁目"),
]
#: What follows the number that patterns 0 and 3 begin with; without it they can't match.
_AFTER_NUMBER = {0: re.compile(r"\d[A-Za-z]?,? (?:[NSEW]\.? )?[A-Z]"), 3: re.compile(r"\d(?: (?:bis|ter|quater))?,? [abcipqrs]")}
#: A number behind a word, and how the words of the German and Dutch patterns end there.
_NUMBER_BEHIND = re.compile(r"[ \n]\d")
_ENDS = {2: ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "hang", "steig", "pfad"), 8: ("straat", "laan", "gracht", "kade", "plein", "dijk", "singel", "weg")}
_ROOM_FOR_NUMBER = re.compile(r"\d")

_UPPER = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
_LETTER = r"(?:[^\W\d_²³¹¼½¾]|[\u0300-\u036f])"
#: A capitalised word: letters, marks, hyphens, and an apostrophe before a capital (O'Brien).
#: What stands before is looked at last, so that the search goes from capital to capital.
CAP = re.compile(rf"[{_UPPER}](?<![\w@\-/#.].)(?<!\w\w['’].)(?:{_LETTER}|-(?={_LETTER})|['’](?=[{_UPPER}]))*(?![\w@€™\x80-\xb6]|\.\w|-\d)")
CAP_ASCII = re.compile(r"[A-Z](?<![\w@\-/#.].)(?<!\w\w'.)(?:[A-Za-z]|-(?=[A-Za-z])|'(?=[A-Z]))*(?![\w@]|\.\w|-\d)", re.A)
_PARTICLE = "de|da|do|dos|das|del|della|di|du|van|von|der|den|ter|ten|zu|la|le|el|al|bin|ibn|ben|y|e"
#: What may stand between the words of a name: a space, a line break, particles, initials.
GAP = re.compile(rf" (?:(?:{_PARTICLE}) )*(?:[{_UPPER}]\. ?)*|\n")
#: Initials and particles before the first word of a name.
LEAD = re.compile(rf"(?<!\w)(?:[{_UPPER}]\. ?|(?:{_PARTICLE}) )+$")
_MARKS = ".,;:!?\"“”„«»()[]…–—-*"
_NEXT2 = re.compile(r"\s*([\w’'\-]+)(?:\s+([\w’'\-]+))?")
_SMALL = re.compile(r"(?<![\w@.\-'’])(?=([a-zß-ÿ]{3,}) ([a-zß-ÿ]{4,})(?![\w@]|\.\w))[a-zß-ÿ]")
_PREV = re.compile(r"([\w’'\-]+)[.,]?\s*$")

# The commonest surnames and the words beside a name in scripts without capitals.
_ZH_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_KO_SURNAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모남궁"
_JA_ROLES = "大家|皆|客|奥|隣|看護師|母|父|兄|姉|弟|妹|医者|運転手|店員|先生|友達|警官|子|娘|息子|祖母|祖父|婆|爺|坊|花嫁|社長|部長|課長"
UNCASED = [
    re.compile(rf"(?P<cue>叫做?|名叫|姓名[是:：]?|同学|我是|见到了?)(?P<name>[{_ZH_SURNAMES}][\u4e00-\u9fff]{{1,2}}?)(?P<after>老师|先生|女士|小姐|医生|同学|经理|来|说|[。，、！？\s]|$)"),
    re.compile(rf"(?P<cue>(?<![\u4e00-\u9fff]))(?P<name>[{_ZH_SURNAMES}][\u4e00-\u9fff]{{1,2}}?)(?P<after>老师|先生|女士|小姐|医生|经理)"),
    re.compile(rf"(?P<cue>)(?<![\u4e00-\u9fff\u30a1-\u30fcおご])(?!(?:{_JA_ROLES})さ)(?P<name>[\u4e00-\u9fff]{{1,4}}|[\u30a1-\u30fa\u30fc]{{2,10}})(?P<after>さん|様|氏(?![\u4e00-\u9fff])|くん|ちゃん)"),
    re.compile(r"(?P<cue>名前は|名は)(?P<name>[\u4e00-\u9fff]{1,5}|[\u30a1-\u30fa\u30fc]{2,10})(?P<after>です|と申します|と言います)"),
    re.compile(rf"(?P<cue>이름은 |저는 )?(?<![가-힣])(?P<name>[{_KO_SURNAMES}][가-힣]{{1,2}})(?P<after> ?씨|님|입니다|이라고| 선생)"),
    re.compile(r"(?P<cue>اسمي|اسمه|اسمها|يدعى|السيد|السيدة|الدكتورة?|الأستاذة?) (?P<name>(?!ال)[\u0621-\u064a]{2,}(?: (?!أمس|في|من|على|إلى)[\u0621-\u064a]{2,})?)(?P<after>)(?=[\s.،؟!]|$)"),
    re.compile(r"(?P<cue>नाम|श्रीमती|श्री|डॉ\.?) (?P<name>[\u0900-\u0963]{2,}(?: [\u0900-\u0963]{2,})?)(?P<after> है| आ| ने|)(?=[\s।,?!]|$)"),
    re.compile(r"(?P<cue>คุณ|นาย|นางสาว|นาง|ชื่อ)(?!ยาย|ตา|พ่อ|แม่|ย่า|ปู่|ลุง|ป้า|น้า|อา|ครู|หมอ)(?P<name>[\u0e01-\u0e4e]{2,14})(?P<after>)(?=[\s.!?]|$)"),
]
_UNCASED_HINT = re.compile(r"[\u4e00-\u9fff\u30a1-\u30fa가-힣\u0621-\u064a\u0900-\u0963\u0e01-\u0e4e]")


@cache
def vocabulary(names: tuple[str, ...] = VOCABULARIES) -> tuple[dict[str, int], dict[str, int]]:
    """How common each word is in small letters, and with a capital: 4 (commonest) to 1, by its rank in the vocabularies."""
    pkg = importlib.import_module("public_tokenizers")
    small: dict[str, int] = {}
    big: dict[str, int] = {}
    for name in names:
        with open(name if "/" in name else pkg.path(name), "rb") as f:
            for rank, line in enumerate(f):
                try:
                    token = base64.b64decode(line.split()[0]).decode()
                except UnicodeDecodeError:
                    continue
                if len(token) > 2 and token[0] == " " and token[1:].isalpha():
                    w = token[1:]
                    to = small if w.islower() else big if w[1:].islower() else None
                    if to is not None:
                        k = 4 if rank < 3000 else 3 if rank < 10_000 else 2 if rank < 25_000 else 1
                        to[w.lower()] = max(k, to.get(w.lower(), 0))
    return small, big


def clean_view(text: str) -> tuple[str, list[int], list[int]] | None:
    """Text without noise (time marks, sound notes, fillers) and the offsets to map back; None if there is none."""
    if not _NOISE_HINT.search(text):
        return None
    out, starts, shifts, at, size = [], [0], [0], 0, 0
    for m in NOISE.finditer(text):
        out.append(text[at : m.start()])
        size += m.start() - at
        at = m.end()
        starts.append(size)
        shifts.append(at - size)
    if not at:
        return None
    out.append(text[at:])
    return "".join(out), starts, shifts


_SENTENCE_END = re.compile(r"[.!?。！？।]+(?=\s|[^\x00-\x7f])|\n|[。！？।]")


def _context(text: str, i: int, j: int) -> tuple[int, int, int]:
    """Nearest cue before and after the span in its sentence (code), and its distance class."""
    before, near = 0, 0
    low, high = max(0, i - 48), min(len(text), j + 36)
    for m in _SENTENCE_END.finditer(text, low, i):
        if m.start() < 4 or text[m.start() - 3 : m.start()].strip().lower() not in ("no", "nr", "tel", "núm"):
            low = m.end()
    m = _SENTENCE_END.search(text, j, high)
    high = m.start() if m else high
    for m in _CUE.finditer(text, low, i):
        before, near = _CUE_CODE[m.lastgroup], min(3, (i - m.end()) // 8)
    m = _CUE.search(text, j, high)
    return before, near, _CUE_CODE[m.lastgroup] if m else 0


def _number_features(text: str, i: int, j: int) -> tuple:
    s = text[i:j]
    core = re.sub(r",? ?(?:ext\.?|x|extension) ?\d+$", "", s)
    digits = sum(c.isdigit() for c in core)
    groups = [len(g) for g in re.findall(r"\d+", core)]
    seps = {c for c in core if not c.isalnum()}
    shape = 0
    for k, p in enumerate(_SHAPES, 1):
        if p.fullmatch(core):
            shape = k
            break
    before, near, after = _context(text, i, j)
    letters = sum(c.isalpha() for c in core)
    return (shape, min(digits, 18), min(len(groups), 8), before, near, after, min(letters, 4), int("+" in core), int(core[:1] == "("), int(core != s), int("-" in seps), int("." in seps), int(" " in seps), int(core.lstrip("+(")[:1] == "0"), min(groups[0], 12), min(groups[-1], 12))


_SHAPES = [
    re.compile(p)
    for p in (
        r"\d{3}[- ]\d{2}[- ]\d{4}", r"\(?\d{3}\)?[-. ]+\d{3}[-. ]\d{4}", r"\d{3}[-. ]\d{4}", r"\+?1?[-. ]?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}", r"\+\d{1,3}[\d ()\-./]{6,16}", r"0\d[\d ()\-./]{6,14}",
        r"(?:19|20)\d{2}[-/](?:\d{2}|(?:19|20)\d{2})", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"\d{2}\.?\d{3}\.?\d{3}-?[A-Z]", r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}", r"\d{2} ?\d{3} ?\d{3} ?\d{3}", r"[A-Za-z]{1,2} ?\d{6,9}", r"[A-Z]\d{3}-\d{4}-\d{4}", r"[A-Za-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Za-z]", r"\d{9}", r"\d{4}-\d{3,4}(?:-\d{2})?", r"\d{2}-\d{2}-\d{2}", r"\d{4}-\d{2}", r"[XYZ]-?\d{7}-?[A-Z]",
    )
]


def _email_features(text: str, i: int, j: int) -> tuple:
    s = text[i:j]
    low = s.lower()
    tail = re.split(r"[.\s\])]+", low)[-1]
    return (int("@" in s), int("(at)" in low or "[at]" in low), int(" at " in low), int(" dot " in low or "[dot]" in low or "(dot)" in low), int("." in s), min(len(tail), 10), int(tail.isalpha()), int(any(c.isdigit() for c in s)), min(len(s) // 4, 20))


def _address_features(text: str, i: int, j: int, kind: int) -> tuple:
    s = text[i:j]
    before, near, after = _context(text, i, j)
    n = re.findall(r"\d+", s)
    prev = _PREV.search(text, max(0, i - 24), i)
    return (kind, min(len(n), 5), min(len(n[0]), 6) if n else 0, before, near, min(s.count(" "), 10), int(bool(prev) and CLASS.get(prev[1].lower()) == _PLACE), int(bool(prev) and prev[1].lower() in ("bus", "route", "no", "nr", "line", "tram")), int(text[j : j + 1] == ","), after)


def _kind(low: str) -> int:
    return 1 if low in GIVEN else 2 if low in WORD_NAMES else 0


def word_class(word: str) -> int:
    """Class of a word beside a candidate."""
    low = word.lower()
    k = CLASS.get(low)
    if k:
        return k
    if word[0].isdigit():
        return NUMERAL
    if low in _IRREGULAR or (len(low) > 3 and low.endswith(_VERB_ENDS) and word == low):
        return VERB
    return CAPITAL if word[0].isupper() else 0


def _language(text: str) -> int:
    """Rough language of a text: 1 where nouns have capitals, 2 Romance, 3 Cyrillic or Greek, else 0."""
    if " und " in text or " der " in text or " die " in text or " das " in text or " ich " in text or " nicht " in text or "Ich " in text or " ein" in text and " war" in text:
        return 1
    if " que " in text or " de " in text or " la " in text or " los " in text or " um " in text or " et " in text:
        return 2
    return 3 if re.search(r"[Ͱ-ӿ]{3}", text) else 0


def _person_features(text: str, i: int, j: int, words: list[str], title: int, language: int, small: dict, big: dict, family: int = 0, comma: int = 0) -> tuple:
    seg = text[max(0, i - 40) : i]
    toks = seg.split()
    p = toks[-1].strip(_MARKS) if toks else ""
    if not p and len(toks) > 1:
        toks.pop()
        p = toks[-1].strip(_MARKS)
    q = toks[-2] if len(toks) > 1 else ""
    n = _NEXT2.match(text, j)
    edge = text[max(0, i - 3) : i].rstrip(" \n\"“„«(")[-1:]
    first, last = words[0].lower(), words[-1].lower()
    start = not p or (edge in ".!?:;" and not title) or ("\n" in text[max(0, i - 3) : i] and first in small)
    prev = EDGE if not p else word_class(p)
    prev2 = EDGE if not q or q[-1] in ".!?" or not (q := q.strip(_MARKS)) else word_class(q)
    nxt = word_class(n[1]) if n else EDGE
    nxt2 = EDGE if not n or not n[2] else word_class(n[2])
    tail = text[j : j + 2]
    after = 1 if tail in ("'s", "’s") else 2 if tail[:1] in ".!?" else 3 if tail[:1] == "," else 4 if not tail.strip() else 5 if tail[:1] in ":;)" else 0
    far = going = 0
    for w in seg.lower().split()[-5:]:
        k = NEAR.get(w if w.isalpha() else w.strip(_MARKS))
        if k:
            far, going = max(far, k[0]), max(going, k[1])
    own = int(start and first.endswith(_OWN_VERB))
    gap = text[i:j]
    classes = [CLASS.get(w.lower()) for w in words]
    return (
        min(len(words), 6), title, _kind(first), _kind(last) if len(words) > 1 else 3, small.get(first, 0), big.get(first, 0), small.get(last, 0), big.get(last, 0),
        AFTER_WORD[prev], AFTER_WORD[prev2], BEFORE_WORD[nxt], BEFORE_WORD[nxt2], int(start), after, int(_INST in classes), int(_TIME in classes),
        language, int(words[-1].isupper() and len(words[-1]) > 1), int("." in gap), int("-" in gap), far, family, comma, going, own, int(edge == ","), small.get(first, 0) if len(words) == 1 else max(small.get(w.lower(), 0) for w in words),
    )


def candidates(text: str) -> Iterator[tuple[str, int, int, tuple]]:
    """Overlapping candidate spans ``(family, start, end, features)`` of every generator."""
    if "@" in text or ((" at " in text or "(at)" in text or "[at]" in text or " AT " in text) and _EMAIL_GATE.search(text)):
        for m in EMAIL.finditer(text):
            if "@" in m[0] or _EMAIL_GATE.search(m[0]):
                yield "email", m.start(), m.end(), _email_features(text, m.start(), m.end())
    if _ROOM_FOR_NUMBER.search(text):
        low = text.lower()
        behind = [m.start() for m in _NUMBER_BEHIND.finditer(low)]
        if _DIGITS5.search(text):
            for m in NUMBER.finditer(text):
                yield "number", m.start(), m.end(), _number_features(text, m.start(), m.end())
            for m in LETTERED.finditer(text) if _LETTERED_HINT.search(text) else ():
                yield "number", m.start(), m.end(), _number_features(text, m.start(), m.end())
        for kind, hints in enumerate(_STREET_HINTS):
            if kind in _AFTER_NUMBER:
                may = _AFTER_NUMBER[kind].search(text)
            else:
                may = any(map(text.__contains__, hints)) or (kind in _ENDS and any(low.endswith(_ENDS[kind], 0, at) for at in behind))
            if may:
                for m in ADDRESS[kind].finditer(text):
                    yield "address", m.start(), m.end(), _address_features(text, m.start(), m.end(), kind)
    yield from _person_candidates(text)


def _odd_pair(words: list[str], small: dict) -> bool:
    """Whether two small-letter words stand together of which the second is out of the vocabulary, and the first too or a name."""
    if not any(w.islower() and w.rstrip(".,;:!?\"”’)").isalpha() for w in set(words).difference(small)):
        return False
    before = False
    for w in words:
        if w in small:
            before = w in GIVEN or w in WORD_NAMES
        else:
            if before and w.islower() and w.rstrip(".,;:!?\"”’)").isalpha():
                return True
            before = w.isalpha() and w.islower()
    return False


def _one_script(word: str) -> bool:
    """Whether the letters are all Latin, all Greek or all Cyrillic (garbled marks are not)."""
    kinds = {0 if c < "\u0370" else 1 if c < "\u0400" else 2 for c in word if c.isalpha()}
    inner = all(c.isascii() or not c.isupper() for c in word[1:]) or word.isupper() or "-" in word
    return len(kinds) == 1 and inner and len(word) > 3


def _person_candidates(text: str) -> Iterator[tuple[str, int, int, tuple]]:
    small, big = vocabulary()
    caps = [(m.start(), m.end(), m[0]) for m in (CAP_ASCII if text.isascii() else CAP).finditer(text)]
    if not text.isascii():
        caps = [c for c in caps if c[2].isascii() or _one_script(c[2])]
    language = -1
    title, at = 0, 0  # class of the last title, and its end
    run: list[tuple[int, int, str]] = []
    runs: list[tuple[list[tuple[int, int, str]], int]] = []

    def close() -> None:
        if run:
            runs.append((run[:], title if 0 <= run[0][0] - at <= 2 else 0))
            run.clear()

    for s, e, w in caps:
        low = w.lower()
        if run:
            g = GAP.fullmatch(text, run[-1][1], s) if s - run[-1][1] < 24 else None
            if g is None or (g[0] == "\n" and not _kind(run[-1][2].lower())):
                close()
        if low in TITLES and text[e : e + 1] in (".", " ") and not (run and low in GIVEN):
            close()
            title, at = (2 if low == "m" else 1), e
        elif len(w) == 1 and w.isascii():
            if not (run and text[e : e + 1] == "."):
                close()  # else an initial inside a name
        elif low in STOP:
            close()
        else:
            if text[s - 2 : s] == ". " and s >= 3 and text[s - 3].isupper() and (s == 3 or text[s - 4].isspace() or text[s - 4] in '("“„«') and not run:
                close()
                title, at = 3, s  # an initial
            run.append((s, e, w))
    close()
    for words, kind in runs:
        if language < 0:
            language = _language(text)
        spans = [words]
        if len(words) > 1:
            # the words of a run that are common in small letters may not belong to the name
            core = [k for k, (*_, w) in enumerate(words) if small.get(w.lower(), 0) < 2 or w.lower() in WORD_NAMES]
            if core and (core[0] > 0 or core[-1] < len(words) - 1):
                spans.append(words[core[0] : core[-1] + 1])
        for ws in spans:
            i, j = ws[0][0], ws[-1][1]
            yield "person", i, j, _person_features(text, i, j, [w for *_, w in ws], kind, language, small, big)
        if len(words) == 1 and text[words[0][1] : words[0][1] + 2] == ", ":
            m = CAP.match(text, words[0][1] + 2)
            if m and m[0].lower() not in STOP:
                i, j = words[0][0], m.end()
                yield "person", i, j, _person_features(text, i, j, [words[0][2], m[0]], kind, language, small, big, 0, 1)
    if " the " in text or " and " in text or " my " in text or " was " in text or " to " in text:
        # two words the vocabularies do not know: a name in small letters
        for m in _SMALL.finditer(text) if _odd_pair(text.split(), small) else ():
            a, b = m[1], m[2]
            if b not in small and (a not in small or a in GIVEN or a in WORD_NAMES) and a not in STOP:
                i, j = m.start(1), m.end(2)
                yield "person", i, j, _person_features(text, i, j, [a, b], 0, 0, small, big, 1)
    if not text.isascii() and _UNCASED_HINT.search(text):
        for k, pattern in enumerate(UNCASED, 2):
            for m in pattern.finditer(text):
                i, j = m.span("name")
                cue, after = m["cue"] or "", m["after"]
                yield "person", i, j, (j - i if j - i < 16 else 16, 0, 0, 0, 0, 0, 0, 0, len(cue), 0, len(after), 0, int(i == 0), 1 if not after.strip() else 2 if after in "。，、！？です" else 0, 0, 0, 4, 0, 0, 0, 0, k, 0, 0, 0, 0, 0)


class Detector:
    """Boosted models of every type, fitted on labelled sentences ``[(text, [(start, end, type)], fold)]``."""

    def __init__(self, labelled: list[tuple[str, list[tuple[int, int, str]], int]]):
        data: dict[str, tuple[list, list, list]] = {t: ([], [], []) for t in TYPES}
        for text, spans, fold in labelled:
            for family, i, j, features in candidates(text):
                # a name must be met as it stands; of the others, any part that is personal counts
                hit = {t for s, e, t in spans if (e == j and s <= i and not LEAD.sub("", text[s:i]) if family == "person" else s < j and i < e)}
                if family == "person" and not hit and any(s < j and i < e for s, e, _ in spans):
                    continue  # a part of a name, address or e-mail says nothing
                for t in ("phone", "id_number") if family == "number" else (family,):
                    data[t][0].append(features)
                    data[t][1].append(int(t in hit))
                    data[t][2].append(fold)
        self.models = {t: Boosted(x, y, folds, NEGATIVES.get(t, 1)) for t, (x, y, folds) in data.items()}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Selected spans in the text, in order and without overlap: the surest first, of equal ones the longest."""
        view = clean_view(text)
        body = view[0] if view else text
        found = []
        for family, i, j, features in candidates(body):
            for t in ("phone", "id_number") if family == "number" else (family,):
                s = self.models[t](features)
                if s > 0:
                    found.append((-s, i - j, i, j, t))
        if not found:
            return []
        taken: list[tuple[int, int, str]] = []
        for *_, i, j, t in sorted(found):
            lead = LEAD.search(body, max(0, i - 16), i) if t == "person" else None
            if lead and lead[0] != "M. ":
                i = lead.start()
            if all(j <= a or i >= b for a, b, _ in taken):
                taken.append((i, j, t))
        taken.sort()
        if view:
            _, starts, shifts = view
            back = lambda p: p + shifts[bisect_right(starts, p) - 1]
            taken = [(back(i), back(j - 1) + 1, t) for i, j, t in taken]
        return taken


@cache
def detector_of(rows: int | None = None) -> Detector:
    """The detector fitted on ``rows`` made sentences; fitted once a process."""
    from storyloom.llm import pii_train

    return Detector(pii_train.sentences(rows or pii_train.ROWS))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by the placeholder of its type."""
    out, at = [], 0
    for i, j, t in spans:
        out += [text[at:i], f"[{t.upper()}]"]
        at = j
    return "".join(out) + text[at:]


def find_pii(df: DataFrame, id_col: str, text_col: str, keep_text: bool = True, rows: int | None = None) -> DataFrame:
    """``(rec_id, pii_types[, redacted])``: one row an id, with the sorted types found and the text with placeholders.

    With ``keep_text=False`` only ids and types are shuffled and records without any type are left out. Null ids and
    null texts give no row, an empty table none; of different texts under an id the types are joined and the greatest
    redacted text is kept. The fitted trees (a few hundred kB) are sent to the executors. Other columns are ignored.
    """
    detector = df.sparkSession.sparkContext.broadcast(detector_of(rows))
    kinds = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("types", kinds), T.StructField("redacted", T.StringType())]) if keep_text else kinds

    def types_of(spans: list) -> pd.Series:
        return pd.Series([sorted({t for *_, t in s}) if s else None for s in spans], dtype=object)

    if keep_text:

        @F.pandas_udf(schema)
        def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in it:
                spans = [detector.value.spans(t) for t in texts]
                yield pd.DataFrame({"types": types_of(spans), "redacted": [redact(t, s) for t, s in zip(texts, spans, strict=True)]})
    else:

        @F.pandas_udf(schema)
        def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in it:
                yield types_of([detector.value.spans(t) for t in texts])

    run = run.asNondeterministic()  # else a filter on the result would be pushed down and the texts read twice
    rows_ = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("rec_id"), run(F.col(text_col)).alias("r"))
    if not keep_text:
        return rows_.where("r is not null").select("rec_id", F.explode("r").alias("pii_type")).distinct()
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("r.types", F.array().cast("array<string>"))))))
    return rows_.groupBy("rec_id").agg(types.alias("pii_types"), F.max("r.redacted").alias("redacted"))
