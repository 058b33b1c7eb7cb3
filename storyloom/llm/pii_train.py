"""Labelled sentences for the personal-information models, made by a small grammar with a fixed seed.

A frame is a sentence with slots: ``{slot}`` is personal (its type is the label), ``<slot>`` is not. Frames come in
folds, so that thresholds are calibrated on sentences of frames the trees have not seen. Names and
places are real ones of common knowledge or invented from syllables, half and half.
"""

from __future__ import annotations

import random
import re
from functools import cache

#: Sentences the models are fitted on.
ROWS = 12_000
#: Folds of frames; each is held out once for calibration.
FOLDS = 4

# Frames. English, then German, French, Spanish, Portuguese, Italian, Dutch, Polish, Russian, and scripts without case.
PERSON = """
My <kin> {given} <did>.|{given} <did>.|{full} <did>.|{given} and {given} <did>.|Yesterday {given} <did>.|Then {full} <did>.|I <met> {name} <when>.|I <met> {name}.|We <met> {given} and the others.|A <kin> named {given} <did>.|Somebody called {full} <did>.|{given}'s <thing> was lost.|We lost {given}’s <thing>.|With {name} I felt safe.|It was {given} who <did>.|It was {full} again.|Was that {given} or somebody else?|Is it {given} or not?|That stayed between {given} and me.|I did it for {given}.|The parcel came from {given}.|Dear {given}, thank you for the <thing>.|Sincerely, {full}|Kind regards, {initial}|Dr. {surname} <did>.|Dr {full} <did>.|I asked Dr. {surname} for the <thing>.|Mr. {surname} <did>.|Mrs {surname} <did>.|Ms. {full} <did>.|Professor {surname} <did>.|The <thing> was signed by {initial}.|The <thing> was signed by {initial}.|The name there was {initial}.|Patient: {listed}, room <n>.|Surname and first name: {listed}.|My <kin>, {full}, <did>.|A <kin>, maybe {full}, <did>.|Nobody worked like {given}.|No one except {given} knew.|My <kin> {full} and her <thing>.|They gave {given} and me a <thing>.|Later {lower} <did>.|and so {lower} told me to go.|Only {given} <did>.|{given}, my <kin>, <did>.|Thanks, {given}!|Ask {given} about it.|Tell {given} that I am late.|Our <kin> {given} from <place> <did>.|{given} from <place> <did>.|When {given} <did>, we cried.|Because {full} <did>, I stayed.|We waited because {given} <did>.|We left since {given} <did>.|It ended when {given} <did>.|I knew that {given} <did>.|Here {given} stopped.|He said that {given} <did>.|She thinks {full} <did>.|She was down as {listed} in the book.|It said {listed} on the door.|The form had {listed} in it.|He signed in as {listed} that day.|{full} was my <kin>.|{full} is a <kin>.|{full} was there.|They had me as {listed} on the list.|Maybe it was {given} or her <kin>.|{given}'s <thing> and {given}'s <thing> were gone.|{given}'s eyes were red.|Signed by {initial}, in pencil.|It ended with {initial}, as always.|Once {lower} <did>.|That day {lower} <did>.|and {lower} asked us in.|{given}'s <thing> broke.|{given}'s voice shook.|{given}'s <thing> was the best of all.|{given}'s old <thing> still works.|{given}’s <kin> <did>.|I liked {given}'s <thing>.|{given}'s legs were tired.|Few people are as kind as {given} is.|Many fight like {given} does.|This boy {given} <did>.|There was a girl, {given}, in the hall.|They sent {given} and me home.|They picked {given} first.|Not {given}!|I told {name} the truth.|I still write to {full}.|I still write to Professor {surname}.|{given} or {given}, I forget.|My name is {name}.|I am {full} and I live in <place>.|The name on it was {full}.|{caps} <did>.|I saw {caps} <when>.|In <place> {given} <did>.|Our <kin> {given} was there.|As {given} said, it was over.|Did {given} call you?|Is {full} your <kin>?|There was {given}, and there was {given}.|Did you know {given}?|The <kin> was {given}, of course.|Sister {given} <did>.|Uncle {given} <did>.|Father {given} <did>.|Judge {surname} <did>.|Later I worked for {full}.|We buried {given} in <month>.
Ich habe {full} alles gesagt.|Ich gab {given} das Buch.|Mein Freund {given} <de_did>.|{full} <de_did>.|Meine Nachbarin {given} <de_did>.|Frau {surname} <de_did>.|Herr {surname} <de_did>.|Ich traf {name} am Bahnhof.|Ich habe mit {name} gesprochen.|Der Chef hieß {full}.|Dann <de_did0> {given} plötzlich.|Er heißt {given}.|Das war {given}.|Wir fragten {full} nach dem Weg.|Herrn {surname} kannte jeder.|Meine Tante {given} <de_did>.
J'ai tout dit à {full}.|J'ai donné le livre à {given}.|C'est M. {surname} qui <fr_did>.|C'était Mme {surname}, je crois.|M. {surname} <fr_did>.|Mon ami {given} <fr_did>.|{full} <fr_did>.|Mme {surname} <fr_did>.|M. {surname} <fr_did>.|Madame {surname} <fr_did>.|Elle s'appelle {name}.|J'ai vu {given} hier.|C'était {full}.|Ma voisine {given} <fr_did>.|Avec {given}, on riait.|J'ai écrit à {full}.|Il a parlé d'{given}.
Le dije todo a {full}.|Se lo di a {given}.|Mi amigo {given} <es_did>.|{full} <es_did>.|El señor {surname} <es_did>.|La señora {surname} <es_did>.|El Sr. {surname} <es_did>.|La Sra. {surname} <es_did>.|El Sr. {surname} <es_did>.|Se llama {name}.|Vi a {given} ayer.|Era {full}.|Mi vecina {given} <es_did>.|Hablé con {full}.|Mi profesor se llamaba {full}.
Disse tudo a {full}.|Dei o livro para {given}.|O meu amigo {given} <pt_did>.|{full} <pt_did>.|A Sra. {surname} <pt_did>.|O senhor {surname} <pt_did>.|Ele se chama {name}.|Vi a {given} ontem.|Falei com {full}.|Minha vizinha {given} <pt_did>.|Escrevi para {full}.
Il mio amico {given} rideva.|La signora {surname} aprì.|Si chiama {full}.|Ho visto {given} ieri.|Mijn vriend {given} lachte.|Mevrouw {surname} belde.|Hij heet {full}.|Ik zag {given} gisteren.|Mój kolega {given} przyszedł.|Pan {surname} dzwonił.|Nazywa się {full}.
Мой друг {ru} пришёл.|{ru_full} позвонил вчера.|Его зовут {ru}.|Я видел {ru_full} на вокзале.|Доктор {ru_sur} сказал нет.|Моя тётя {ru} плакала.|С нами был {ru}.
我叫{zh}。|他的同学{zh}来了。|{zh}老师说不行。|我见到了{zh}。|{zh}先生打来电话。|田中から{ja}さんに電話した。|{ja}さんが来ました。|私の名前は{ja}です。|제 이름은 {ko}입니다.|{ko} 씨가 왔어요.|اسمي {ar}.|قابلت السيد {ar} أمس.|मेरा नाम {hi} है।|श्री {hi} आए थे।|ผมชื่อ{th}|คุณ{th} มาแล้ว
""".strip()  # fmt: skip
OTHER = """
Back in <place> it rained.|We flew to <place> <when>.|She lives near <place>.|They came from <place>.|From <place> we took the bus.|In <place> nobody slept.|<place> was cold that year.|<place> is far away.|It rained in <place> all <weekday>.|Between <place> and <place> the road ends.|The <place> <inst> was closed.|We met at the <place> <inst>.|<place> <inst> opened late.|The <inst> of <place> burned.|On <weekday> we left.|Last <month> my <kin> <did>.|<Common> <did>.|<Common> was all I wanted.|<Common> and <common> are not the same.|I had no <common> left.|The Dr. on call <did>.|The Prof. was ill.|Mr. and Mrs. came too.|My <kin> <did>.|Our <kin> was kind.|I hope you will come.|Hope is all we had.|Grace under pressure, she called it.|Will you wait?|Mark the date, please.|May I go?|Rose petals fell.|Faith can move mountains.|With hope, faith and joy we went on.|Joy came later.|Bill after bill came in.|We hiked past <place>.|He spoke <language> at home.|The <language> teacher <did>.|<language> was easy.|At <holiday> we stayed home.|My <kin> works for the FBI.|NATO troops left.|WE NEVER TALKED ABOUT IT.|She read The <Common> of <place>.|THE DOOR WAS OPEN.|<street> was blocked.|We crossed <street> at noon.|The corner of <street> was dark.|<gib>|<gib>|<gib>|Chapter <n> begins.|Room <n> was free.|At <n> p.m. it ended.|It was the U.S. in <year>.|The <Common> <inst> closed.|I read a book called The <Wordname> <inst>.|The <Wordname> <inst> <did>.|We saw <Wordname> <inst> from afar.|All the way to <place> we ran.|She walked to <place> alone.|The road to <place> was long.|My <kin> <did> in <place>.|We took a bus to <place>.|We lived above St. <place>.|St. <place>'s <inst> was near.|Near St. <Wordname>'s there was a <inst>.|<place>'s streets were empty.|In <place>'s old <inst> we sang.|Three miles from <place> we slept.|They returned from <place>.|It broke somewhere in <place>.|The <place> <inst> called about the <thing>.|The <place> Times wrote about it.|We stayed in <place> or left.|Is <place> nice?|Somewhere around <place> we stopped.|The whole way to <place> we sang.|Nobody in <place> knew.|God knows why.|Mom and Dad <did>.|Mom <did>.|Grandma <did>.|My <kin> and I <did>.|INTERVIEWER: What happened then?|RESPONDENT: Nothing.|Plan C. <Common> won.|<Common>, they say, is <common>.|<Wordname>, he said, is <common>.|<Common>, <Common> and <common>.|<place>, <place> and <place> were next.|NO, <CAPS>, NO.|It said <CAPS>, <CAPS> on the wall.|<CAPS> AND <CAPS> were written there.|Somewhere between <place> and <place> it broke.|Halfway from <place> to <place> we ate.|Like <common>, it fades.|Like <place>, it was small.|The <small> burned.|The <small> <did>.|We ate <small> there.|My <kin> likes <small> a lot.|Then the <small> was gone.|Between <place> and <place> I had no <common>.|We drove between <place> and <place>, and it rained.|Somewhere near <place> and <place> we slept.|They had <place> and <place> on the map.|Internet was slow.|The Earth is round.|We called <place> our home.|<place>, on the coast, was quiet.|After <place> we were tired.
Der <de_noun> stand im <de_noun>.|Die Frau ging mit dem <de_noun> nach <place>.|Mein <de_noun> und dein <de_noun> waren alt.|Das war <de_noun> genug.|In <place> war alles still.|<de_adv> kam der Winter.|Wir hatten <de_noun> und <de_noun>.|Am Montag fuhr der Zug nach <place>.|Wir hatten <de_noun>, <de_noun> usw.|Sie eröffnete eine kleine <de_noun> nach dem Krieg.|In der Nähe von <place> war es still.|Die <de_adj> <de_noun> war fort.|Er zahlte den <de_adj> <de_noun> im <de_noun>.|Sie kaufte <de_adj> <de_noun> am Abend.|Das <de_adj> <de_noun> brannte.|Wir lernten, um <de_noun> zu bitten.|Es gab <de_noun>, aber kein Geld.|Herr und Frau waren fort.|Der Arzt sprach über <de_noun>.|Zum <de_noun> gingen wir spät.|Vor dem <de_noun> wartete meine Mutter.|Ohne <de_noun> ging nichts.|Er kam ins <de_noun>.|Mein Bruder fuhr zum <de_noun> und dann ins <de_noun>.|Seile, <de_noun> und <de_noun> lagen da.|Unser <de_noun> verkaufte das <de_noun>.|Es war der <de_noun> meines Lebens.|<de_noun> <de_did>.|Alle <de_noun> waren fort.|Wir kauften <de_noun>.|Es kostete <n> Euro inkl. <de_noun>.|Der Chef heißt nicht so.|Meine <de_kin> rief an.|Dann kam meine <de_kin> zurück.|Ich wusste, meine <de_kin> <de_did>.
À <place>, il pleuvait.|Le maire de <place> est venu.|Nous habitions près de <place>.|<fr_adv>, tout a changé.|La rivière passe à <place>.|Mme la présidente a parlé.|M. le maire est parti.|LE MUSÉE EST FERMÉ.|La France est belle.|Est-ce que tu viens ?|Parfois, <common>.|Peut-être que oui.|<fr_adv> que tout change.
En <place> llovía.|El alcalde de <place> vino.|<es_adv> todo cambió.|El Sr. alcalde habló.|La Dra. de guardia salió.|Fuimos a <place> en verano.|Desde <place> hay un tren.|Recuerdo que llovía.|Recuerdo que mi <kin> vino.|Creo que no.|<es_verb> mi vida.|<es_verb> todo en <place>.|<es_verb> la casa y el coche.|<pt_verb> a casa.|<pt_verb> tudo em <place>.|Dicen que sí.|Parece que todos ríen.|Teníamos hambre en <place>.|Lembro que chovia.|Acho que não.|Parece que sim.|Dizem que choveu.|Em <place> chovia.|O prefeito de <place> veio.|<pt_adv> tudo mudou.|A Sra. diretora saiu.|Fomos para <place> no verão.|A <place> vado in treno.|In <place> regende het.|W <place> padało.|Il Sig. direttore parla.
<ru_noun> <ru_did>.|<ru_noun> <ru_did>.|Тогда <ru_did> мой дядя.|Неужели я прав?|Теперь я знаю.|Почему ты молчал?|Когда он ушёл, стало тихо.|Может, я забыл.|Сначала мы молчали.|Моя <ru_low> <ru_did>.|В <ru_place> шёл снег.|Вчера мы поехали в <ru_place>.|Потом всё изменилось.|Мама сказала нет.|Никто не пришёл.|这里没有人。|我的老师很好。|先生不在家。|お母さんが来ました。|先生に電話した。|아버지가 왔어요.|السيد المدير مشغول.|मेरा नाम मत पूछो।|คุณมาจากไหน
""".strip()  # fmt: skip
NUMBERS = """
Call me at {phone}.|My number is {phone}.|{phone} is my cell.|You can reach us on {phone} after five.|Tel. {phone}|Phone: {phone}|I rang {phone} for hours.|Text {phone} when you land.|She wrote {phone} on my hand.|Her number, {phone}, was wrong.|{phone} rang all night.|I still remember {phone} today.|They gave me {phone} and a key.|Meine Nummer ist {phone}.|Rufen Sie {phone} an.|Mon numéro est le {phone}.|Appelez le {phone}.|Mi teléfono es {phone}.|Llame al {phone}.|O meu telefone é {phone}.|Ligue para {phone}.|Il mio numero è {phone}.|Мой номер {phone}.|电话是{phone}。|電話は{phone}です。|전화번호는 {phone}입니다.|मेरा फ़ोन नंबर {phone} है।|رقم هاتفي {phone}.|เบอร์โทร {phone}
My <idname> is {id}.|My <idname> was {id}, they said.|<idname>: {id}|Enter your <idname> ({id}).|{id} is my <idname>.|He read out my <idname>, {id}, in public.|The <idname> on file was {id}.|I lost my <idname> {id}.|They copied {id} from my <idname>.|Meine Passnummer ist {id}.|Meine Steuernummer {id} steht dort.|Mon numéro de passeport est {id}.|Mon numéro de sécurité sociale est {id}.|Mi DNI es {id}.|Mi número de pasaporte es {id}.|O meu CPF é {id}.|Meu passaporte é {id}.|Il mio codice fiscale è {id}.|Номер паспорта {id}.|我的身份证号是{id}。|मेरा आधार नंबर {id} है।
Order <serial> never arrived.|The serial number is <serial>.|Invoice <serial> was paid.|Ticket no. <serial> is closed.|Lot <serial> was sold.|Part <serial> broke.|Case <case> was dismissed.|File <case> is missing.|Tracking code <serial>.|In the season <season> we lost.|The <season> season was short.|That was the <season> season.|School year <season> began.|From <year> to <year> we had <n> goats.|Version <version> was better.|It cost <money> dollars.|The score was <dec> against <dec>.|On page <n> of <n> it says so.|We counted <big> people.|Flight <n> left at <n>:<n>.|The model <serial> is old.|ISBN <isbn>|Batch <serial> went back.|Rechnung <serial> ist offen.|La commande <serial> est perdue.|El pedido <serial> no llegó.|O pedido <serial> sumiu.|It took <n> to <n> days.|A sample of <big> cases, <dec> percent.|Engine <serial> failed.|On <date> it began.
""".strip()  # fmt: skip
EMAILS = """
My email is {email}.|Write to {email}.|{email} is my address.|Send it to {email}, please.|I used {email} back then.|Schreiben Sie an {email}.|Mon adresse est {email}.|Mi correo es {email}.|O meu e-mail é {email}.|Пишите на {email}.|邮箱是{email}。|Contact: {email}|It bounced from {email} twice.
We were at home at <n> dot.|Look at the dot on the map.|I stared at him.|We tweeted @ them.|Meet me @ noon.
""".strip()  # fmt: skip
ADDRESSES = """
We lived at {address}.|We lived at {address}, <place>.|Write to {address} in <place>.|Vivíamos en {address_es}, <place>.|Moro na {address_pt}, <place>.|J'habite {address_fr} à <place>.|Ich wohne {address_de} in <place>.|Our house was {address}.|I grew up at {address}, upstairs.|Send it to {address}.|{address} was our first flat.|The taxi took me to {address}.|My address is {address}.|She moved to {address} <when>.|Wir wohnten in der {address_de}.|Ich wohne {address_de}.|Sie zog in die {address_de}.|J'habite {address_fr}.|On habitait au {address_fr}.|Vivo en {address_es}.|Vivíamos en la {address_es}.|Moro na {address_pt}.|A gente vivia na {address_pt}.|Abito in {address_it}.|Ik woon op de {address_nl}.|Mieszkam przy {address_pl}.|Мы жили на {address_ru}.|我住在{address_zh}。
We walked down <street>.|Bus <n> to <street> was late.|Line <n> to <place> stops here.|We waited <n> minutes on <street>.|Route <n> was closed.|Das Haus Nr. <n> war alt.|In der Straße war es still.|La rue était vide.|La calle estaba vacía.|A rua estava vazia.|Box of <n> apples.|It took <n> days.
""".strip()  # fmt: skip

# Words for the slots.
KIN = "aunt uncle cousin brother sister neighbour neighbor friend colleague coworker roommate boss manager coach teacher nurse mentor landlord boyfriend wife husband son daughter grandfather grandmother classmate therapist".split()
DID = "drove me to the station|never wrote back|laughed out loud|came over with soup|lost her keys|wanted to quit|was late again|had already left|took the blame|found the letter|kept quiet|is a dentist now|played the drums|moved abroad|would not listen|did not care|knew the answer|waited outside|held the baby|read it aloud|sang for us|cried|won|called me back|stood there|made tea|gave me a map|got sick|went home early|said no|opened a window|walked in|ran after us|helped me move|told me to rest|hung up|nodded|brought bread".split("|")
SAW = "met phoned thanked visited trusted missed married remembered told asked blamed called saw knew loved hired followed".split()
WHEN = "yesterday|last week|in spring|on the train|after work|at school|that night|years ago".split("|")
THING = "letter bike report coat guitar key form ticket photo essay dress garden".split()
COMMON = "music rain hunger money silence pride love anger weather dinner homework traffic luck patience sleep courage work summer winter trust honesty fear home freedom evening school".split()
LANGUAGES = "English German French Spanish Italian Polish Russian Arabic Chinese Dutch".split()
HOLIDAYS = "Christmas Easter Thanksgiving Ramadan Diwali Halloween".split()
DE_DID = "lachte laut|kam zu spät|rief mich an|sagte kein Wort|ging nach Hause|hat geholfen|war dabei|wollte nicht|öffnete das Fenster".split("|")
FR_DID = "a ri|est venu|m'a appelé|ne disait rien|est parti tôt|a ouvert la fenêtre|voulait rester".split("|")
ES_DID = "se rió|llegó tarde|me llamó|no dijo nada|abrió la ventana|vino a casa|quería irse".split("|")
PT_DID = "riu|chegou tarde|me ligou|não disse nada|abriu a janela|veio aqui|queria ficar".split("|")
DE_NOUN = "Garten Winter Zug Brief Hund Wagen Kinder Hoffnung Arbeit Brot Sommer Lehrer Schule Fenster Tisch Glück Musik Angst Stunde Werkstatt".split()
DE_ADV, FR_ADV, ES_ADV, PT_ADV = "Plötzlich Natürlich Damals Irgendwann Trotzdem".split(), "Soudain Heureusement Parfois Ensuite".split(), "Entonces Después Siempre Nunca".split(), "Depois Então Sempre Nunca".split()
INSTITUTIONS = "Museum Hospital School Theatre Hotel Station College Library Park Bridge Clinic Festival Church Airport River Lake Market Stadium Garden Club Review".split()
SYLLABLES = "ka ro li men da tor vel ish an bre co dun es far gri hol im jen lor mir nar os pel qui ras sel tam ul ver wil yar zen bal cor fen é lo šá ö ń mo ti du sa be ki".split()
SURNAME_ENDS = "berg mann son es sky lini ford vik dal gard etti ova ard ier eau er ski ham rost ell ins ton ley ić ák ón".split()
PLACE_ENDS = "field bury mouth wick ville stead haven moor dale burg port ham land wood brook heim ia ona ford ton".split()
SURNAMES = "Smith Johnson Williams Brown Taylor Wilson Walker Robinson Clark Baker Cooper Fisher Müller Schmidt Schneider Weber Wagner Becker Hoffmann Dubois Moreau Laurent Lefèvre García Fernández González López Martínez Rodríguez Silva Santos Oliveira Pereira Costa Rossi Russo Ferrari Jansen Bakker Kowalski Nowak Novák Horváth Andersson Åkesson Hansen O'Brien O'Connor McAllister MacDonald Yılmaz Nguyen Khan Patel Singh Tanaka Kim Chen Wang Okafor Haddad".split()
PLACES = "Berlin Hamburg Lisbon Porto Madrid Seville Paris Lyon Rome Turin London Leeds Chicago Denver Boston Dallas Ohio Texas Oregon Vienna Zürich Prague Warsaw Dublin Cairo Lagos Delhi Tokyo Sydney Toronto Lima Oslo Ghent Ghana Italy Spain Kenya".split()
#: Given names that are not in the list the features know, so that the trees do not rely on it.
UNLISTED = "Albert Arthur Bruno Clara Diego Elena Emil Erik Felix Fiona Gloria Greta Hannah Helena Hugo Ines Irene Jakob Julia Kai Lara Leon Liam Lina Lorenzo Louise Lukas Magda Manuel Marta Martin Max Mia Milan Moritz Nina Noah Nora Oliver Oskar Otto Paula Pavel Rafael Rita Roberto Roman Ruth Samir Simon Sofia Sonja Stella Sven Tamara Teresa Theo Tim Tom Valentina Vera Victor Vincent Walter Yusuf Zoe".split()
RU_GIVEN, RU_SURNAMES, RU_PLACES = "Иван Анна Олег Мария Павел Ольга Сергей Наталья Дмитрий Светлана".split(), "Петров Иванов Смирнов Кузнецов Соколов Лебедев".split(), "Москве Казани Омске Перми Туле".split()
ZH, JA, KO = "王小明 李娜 张伟 刘洋 陈静 杨丽 赵强 黄敏 周杰 吴芳".split(), "田中 山田 佐藤 鈴木 高橋 中村".split(), "김민수 이지은 박서준 최유진 정하늘".split()
AR, HI, TH = "أحمد|محمد علي|فاطمة|خالد|مريم".split("|"), "राहुल शर्मा|प्रिया|अमित|सुनीता|विजय सिंह".split("|"), "สมชาย|สมศรี|วิชัย|มานี".split("|")
ID_NAMES = ["social security number", "SSN", "passport number", "passport", "driver's license", "licence number", "visa number", "tax ID", "tax number", "national ID", "identity card number", "national insurance number", "Aadhaar", "student visa"]
STREET_TYPES = "Street St. St Avenue Ave Ave. Road Rd Lane Court Drive Blvd Place Way Square Terrace".split()
PHONES = ["(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "999 999 9999 ext. 99", "999-999-9999 x999", "+1 999 999 9999", "1-999-999-9999", "19999999999", "999-9999", "09999 999 999", "09999 999999", "+44 9999 999999", "020 9999 9999", "+49 99 99999 999", "099/99999999", "+49 (0)99 99999-999", "09 99 99 99 99", "09.99.99.99.99", "0999999999", "+33 9 99 99 99 99", "+34 999 99 99 99", "999 999 999", "+55 99 99999-9999", "(99) 99999-9999", "+7 999 999-99-99", "+39 09 9999 9999", "8 999 999 99 99", "+91 99999 99999", "139 9999 9999", "090-9999-9999", "010-9999-9999"]
IDS = ["999-99-9999", "999 99 9999", "999999999", "L9999999", "LL 999999", "LL999999", "L99999999", "L999-9999-9999", "LL 99 99 99 L", "ll-99-99-99-L", "LL999999L", "999.999.999-99", "99.999.999-L", "99999999L", "9 99 99 99 999 999 99", "999999999999999", "99 999 999 999", "99999999999", "L-9999999-L", "9999 9999 9999", "999999999999999999", "LLLLLL99L99L999L"]
SERIALS = ["999-99-9999", "99999-999", "999999999", "99-9999-99", "9999-9999-99", "99999999", "99-99-99", "999-99-999", "9999999999", "99-999-9999", "L9999999", "LL-99999"]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def mask(self, *masks: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "9" else self.r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "L" else self.r.choice("abcdefgh") if c == "l" else c for c in self.r.choice(masks))

    def word(self, n: int = 2) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(n))

    def given(self) -> str:
        from storyloom.llm.pii import GIVEN, WORD_NAMES

        k = self.r.random()
        if k < 0.2:
            return self.r.choice(UNLISTED)
        if k < 0.5:
            return self.word(self.r.randint(2, 3)).capitalize()
        return self.r.choice(sorted(WORD_NAMES) if k < 0.65 else sorted(GIVEN)).capitalize()

    def surname(self) -> str:
        s = self.r.choice(SURNAMES) if self.r.random() < 0.4 else (self.word(self.r.randint(1, 2)) + self.r.choice(SURNAME_ENDS)).capitalize()
        k = self.r.random()
        return f"{s}-{self.surname()}" if k < 0.06 else f"{self.r.choice(['de', 'van', 'von', 'da', 'van der'])} {s}" if k < 0.1 else s

    def full(self) -> str:
        middle = self.r.choice(["", "", "", "", f"{self.r.choice('ABEJMRS')}. ", f"{self.given()} "])
        return f"{self.given()} {middle}{self.surname()}"

    def place(self) -> str:
        p = self.r.choice(PLACES) if self.r.random() < 0.4 else self.word(self.r.randint(1, 2)).capitalize() + self.r.choice(PLACE_ENDS)
        k = self.r.random()
        return self.r.choice(["Port ", "Lake ", "New ", "Old ", "Upper ", "North ", "Saint-", "San ", "Mount "]) + p if k < 0.2 else p + self.r.choice([" Bay", " Hill", " Valley", " Beach"]) if k < 0.3 else p

    def street(self) -> str:
        return f"{self.word(2).capitalize()} {self.r.choice('Street Avenue Road Lane Drive'.split())}"

    def gibberish(self) -> str:
        """A sentence in a language nobody knows: a capital tells nothing there."""
        return " ".join(self.word(self.r.randint(1, 3)) for _ in range(self.r.randint(4, 8))).capitalize() + "."

    def address(self, kind: str) -> str:
        r, n, w = self.r, self.r.randint(1, 999), self.word(2).capitalize()
        if kind == "de":
            return r.choice([f"{w}straße {n}", f"{w}er Str. {n}", f"{w}gasse {n}", f"{w}weg {n}", f"Am {w} {n}", f"{w}platz {n}a"])
        if kind == "fr":
            return r.choice([f"{n} rue {w}", f"{n}, rue de {w}", f"{n} bis, avenue du {w}", f"{n} boulevard {w}", f"{n} chemin des {w}", f"{n} place {w}"])
        if kind == "es":
            return r.choice([f"calle {w} {n}", f"Calle de {w}, {n}", f"Avda. {w} {n}", f"Plaza {w}, {n}", f"calle {w}, n.º {n}", f"Avda. de la {w} n.º {n}"])
        if kind == "pt":
            return r.choice([f"Rua {w}, {n}", f"Rua da {w}, {n}", f"Av. {w}, {n}", f"Travessa do {w}, {n}"])
        if kind == "it":
            return r.choice([f"Via {w} {n}", f"via {w}, {n}", f"Piazza {w} {n}", f"Corso {w}, {n}", f"Viale {w} {n}"])
        if kind == "nl":
            return r.choice([f"{w}straat {n}", f"{w}laan {n}", f"{w}gracht {n}", f"{w}weg {n}"])
        if kind == "pl":
            return r.choice([f"ul. {w}ska {n}", f"ulicy {w}iej {n}", f"al. {w} {n}", f"ul. {w} {n}/{n % 9 + 1}"])
        if kind == "ru":
            return r.choice([f"ул. Ленина, д. {n}", f"улице Гоголя {n}", f"ул. Пушкина {n}", f"проспект Мира, {n}"])
        if kind == "zh":
            return r.choice([f"人民路{n}号", f"长江街{n}号", f"北京大道{n}号"])
        t = r.choice(STREET_TYPES)
        head = r.choice([f"{n}", f"{n}", f"{n}", f"{n} {r.choice('NSEW')}.", f"{n}-{n + 2}", f"Flat {r.randint(1, 40)}, {n}", f"Unit {r.randint(1, 40)}, {n}", f"{n}B"])
        return r.choice([f"{head} {w} {t}", f"{head} {w} {t}", f"{head} {w} {self.word(2).capitalize()} {t}", f"P.O. Box {n}", f"PO Box {n}", f"{head} {w} {t}, Apt {r.randint(1, 90)}"])

    def email(self) -> str:
        r = self.r
        a, b = self.word(2), self.word(2) + r.choice(SURNAME_ENDS)
        user = r.choice([f"{a}.{b}", f"{a}_{b}", f"{b}.{a[0]}", f"{a}{r.randint(1, 99)}", f"{a}-{b}", f"{a[0]}{b}+{self.word(1)}{r.randint(1, 99)}"])
        user = user.encode("ascii", "ignore").decode().strip(".-_+") or "me"
        host = r.choice(["example.org", "mail.example.com", "uni.example.edu", "example.net", "post.test", "example.de", "example.co.uk", "letters.invalid"])
        at, dot = r.choice([("@", ".")] * 8 + [(" (at) ", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" AT ", " DOT ")])
        e = f"{user.replace('.', dot)}{at}{host.replace('.', dot)}"
        return e.upper() if r.random() < 0.08 else f"<{e}>" if r.random() < 0.05 and at == "@" else e

    def fill(self, slot: str) -> str:
        r = self.r
        if slot.startswith("address"):
            return self.address(slot[8:])
        if slot == "name":
            slot = r.choice(["given", "given", "full", "surname"])
        if slot in _MAKE:
            return getattr(self, _MAKE[slot])()
        if slot in _CHOICE:
            return r.choice(_CHOICE[slot])
        made = {
            "initial": lambda: f"{r.choice('ABCDEFGHJKLMMMNPRSTVW')}. {self.surname()}",
            "listed": lambda: f"{self.surname()}, {self.given()}",
            "lower": lambda: f"{self.given()} {self.surname()}".lower().replace("-", ""),
            "caps": lambda: self.full().upper(),
            "Wordname": lambda: r.choice(["Amber", "Rose", "Ruby", "Olive", "Hunter", "Pearl", "Crystal", "Hope", "Grace", "Silver", "Golden", "Broken", "Last"]),
            "CAPS": lambda: r.choice([*COMMON, "irmã", "mãe", "âge", "grâce", "größe", "año", "ähre"]).upper(),
            "Common": lambda: r.choice(COMMON).capitalize(),
            "ru_full": lambda: f"{r.choice(RU_GIVEN)} {r.choice(RU_SURNAMES)}",
            "phone": lambda: self.mask(*PHONES),
            "id": lambda: self.mask(*IDS),
            "serial": lambda: self.mask(*SERIALS),
            "case": lambda: self.mask("2099-999", "2099-9999", "1999/9999"),
            "season": lambda: self.mask("1989-99", "2009-19"),
            "version": lambda: self.mask("2.0.9", "1.19.99"),
            "dec": lambda: self.mask("1.9", "99.9", "9,9", "99,9"),
            "isbn": lambda: self.mask("978-9-999-99999-9"),
            "big": lambda: self.mask("9,999", "99,999", "9999", "999.999", "99999"),
            "date": lambda: self.mask("09.09.2009", "2009-09-09", "09/09/1999"),
            "n": lambda: str(r.randint(1, 99)),
            "year": lambda: self.mask("1999", "2019"),
            "money": lambda: self.mask("99.99", "9.99", "9999"),
        }
        return made[slot]()


_MAKE = {"given": "given", "surname": "surname", "full": "full", "place": "place", "street": "street", "email": "email", "gib": "gibberish"}
_CHOICE = {
    "kin": KIN, "did": DID, "met": SAW, "when": WHEN, "thing": THING, "common": COMMON, "language": LANGUAGES, "holiday": HOLIDAYS, "inst": INSTITUTIONS, "idname": ID_NAMES,
    "de_did": DE_DID, "de_did0": ["lachte", "kam", "rief", "ging"], "fr_did": FR_DID, "es_did": ES_DID, "pt_did": PT_DID, "de_noun": DE_NOUN, "de_adv": DE_ADV, "fr_adv": FR_ADV, "es_adv": ES_ADV, "de_kin": "Mutter Großmutter Tochter Oma Nichte Frau Enkelin Schwägerin".split(), "de_adj": "ganze kleine alte neue schöne große letzte nächste kalte stille".split(), "small": ["crème fraîche", "pad thai", "kung fu", "tarte tatin", "dulce leche", "café latte", "gado gado", "foie gras", "schadenfreude moment", "tai chi"], "es_verb": "Cambió Llegamos Teníamos Vendió Aprendí Sentí Recuerdo Quería Éramos Lloré Fuimos Hubo".split(), "pt_verb": "Estávamos Aprendi Mudou Vendeu Chorei Fomos Queria Lembro Deixei Éramos".split(), "pt_adv": PT_ADV,
    "ru": RU_GIVEN, "ru_sur": RU_SURNAMES, "ru_place": RU_PLACES, "ru_noun": ["Тренер", "Учитель", "Врач", "Сосед", "Никто", "Дождь", "Мальчик", "Соседка", "Автобус"], "ru_low": ["мама", "дочь", "соседка"], "ru_did": ["пришёл поздно", "нашёл письмо", "сказал нет", "ушёл домой", "плакал", "позвонил", "молчал"], "zh": ZH, "ja": JA, "ko": KO, "ar": AR, "hi": HI, "th": TH,
    "month": ["April", "June", "March", "August", "May", "January", "September"], "weekday": ["Sunday", "Monday", "Friday", "Tuesday"],
}
_SLOT = re.compile(r"\{(\w+)\}|<(\w+)>")
_TYPE = {"email": "email", "phone": "phone", "id": "id_number"}
#: Leads that stand before a sentence in speech.
_LEADS = ["", "", "", "", "Well, ", "So ", "And ", "Then ", "I mean, ", "You know, ", "But "]


@cache
def _frames() -> list[list[str]]:
    """Frames of each kind, in a fixed order."""
    return [[f for line in block.split("\n") for f in line.split("|")] for block in (PERSON, OTHER, NUMBERS, EMAILS, ADDRESSES)]


def sentences(rows: int = ROWS, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]], int]]:
    """``(text, spans, fold)``: texts of one to three sentences, whose frames are all of one fold."""
    maker = _Maker(seed)
    r = maker.r
    out = []
    while len(out) < rows:
        fold = r.randrange(FOLDS)
        text, spans = "", []
        for _ in range(r.choice([1, 1, 2, 3])):
            pool = [f for k, f in enumerate(_frames()[r.choices(range(5), [40, 32, 12, 5, 11])[0]]) if k % FOLDS == fold]
            frame = r.choice(pool)
            text += " " if text else ""
            lead = r.choice(_LEADS)
            if lead and frame[:2] not in ("I ",) and frame[0].isascii() and frame[0].isupper() and not frame.isupper():
                frame = frame[0].lower() + frame[1:]
            text += lead if frame[0].isascii() else ""
            at = 0
            for m in _SLOT.finditer(frame):
                text += frame[at : m.start()]
                slot = m[1] or m[2]
                value = maker.fill(slot)
                if m[1]:
                    spans.append((len(text), len(text) + len(value), _TYPE.get(slot, "address" if slot.startswith("address") else "person")))
                text += value
                at = m.end()
            text += frame[at:]
        out.append((text, spans, fold))
    return out
