"""Training sentences for personal data: patterns with slots, filled with made-up values.

``{name}`` and so on are entities; every other word is none. The patterns and the lists of names, streets and towns were
written for this purpose, without a look at any table; values are drawn from them or made by rule. The model is trained on
these alone. A pattern may run over several lines ("¶" between them).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Patterns with personal data.
PATTERNS = """Contact person: {name}
Contact person: {name} ({phone})
You can reach {name} at {phone} or by mail at {email}.
The applicant, {name}, has {label} {id} and stays at {address}.
Mr. {name} of {address} came to our office.
Mrs {name}, aged 41, resident of {address}, states on oath as follows.
Dear {name},
Dear Ms. {name},
Dear Sir, I am {name} and my phone is {phone}.
Hello, this is {name}. My number changed to {phone}.
Hi team, {name} here, please ring me on {phone} after six.
Yours faithfully,¶{name}
Yours truly,¶{name}¶{phone}
Best regards,¶{name}¶Mobile: {phone}¶Email: {email}
With regards, {name}
Thanks, {name}
Sincerely, {name}
To,¶{name},¶{address}
To¶Shri {name}¶{address}
From: {name} <{email}>
From: {email}
Cc: {email}, {email}
Mail us at {email}.
Send the scanned copy to {email} before {date}.
If in doubt call {phone}.
Tel: {phone}
Tel. {phone}, Fax {phone}
Mobile no. {phone}
Phone¶{phone}
Customer care number {phone} is open all day.
Call our toll free line {phone} now.
My {label} {id} is not linked.
Verified with {label} {id} on {date}.
{label} {id}
Proof of identity: {label} {id}
KYC: {label} {id}; {label} {id}
{name}, {label} {id}, {address}
Name: {name}
Name: {name}, {label} {id}
Customer name: {name}¶Address: {address}¶Phone: {phone}
Address: {address}
Residential address: {address}.
Permanent address {address}
His new home is {address}.
Please deliver the card to {address} and not to the old flat.
She moved from {address} to {address} last spring.
The summons could not be served on {name} at {address}.
The witness {name} was examined and cross-examined at length.
The complainant {name} appeared in person.
Petitioner {name} and respondent {name} have settled.
Between {name} and {company}.
Affidavit of {name}, son of {name}.
{name}, wife of {name}, nominee of the deposit.
Guardian: {name}.
Nominee {name} ({phone}).
Nominee: {name} | Phone: {phone}
Prepared by {name}, checked by {name}.
Signed by {name} on {date}
sd/- {name}
Sd/- {name}, Manager
c/o {name}, {address}
Account opened by {name} with {bank}.
Payment of {amount} was made to {name} by cheque.
Transfer {amount} to {name}, UTR {number}.
The locker is in the joint names of {name} and {name}.
The director {name} (DIN {number}) retired by rotation.
Mr {name} told the bank that the card was lost.
Ask for {name} at the desk.
Our officer {name} will visit you; his phone is {phone}.
Refund the fare to Dr. {name} please.
Letter from {name} dated {date}
Hand it over to {name} only.
Caller: {name}, callback {phone}
Ticket raised by {name} ({email})
{name} - {phone}
{name} / {phone} / {email}
{name}
{address}
{email}
{phone}
M. {name} habite {address}.
Madame {name} nous a appelés au {phone}.
Je soussigné {name}, demeurant {address}, certifie ce qui suit.
Vous pouvez joindre {name} par courriel : {email}.
Monsieur {name},
Le client {name} a présenté sa carte d’identité {id}.
Numéro de téléphone : {phone}
Titulaire : {name}, passeport n° {id}
Adresse : {address}
Herr {name} wohnt in {address}.
Frau {name} erreichen Sie unter {phone}.
Sehr geehrter Herr {name},
Der Kunde {name} legte den Ausweis {id} vor.
Ansprechpartner: {name}, Telefon {phone}, {email}
Personalausweis {id}
Meine neue Anschrift lautet {address}.
Mit freundlichen Grüßen¶{name}
आवेदक {hname} का मोबाइल नंबर {phone} है।
श्री {hname} निवासी {haddress} ने शपथ पत्र दिया।
मेरा नाम {hname} है और मैं {haddress} में रहता हूँ।
संपर्क करें: {hname}, {phone}
कृपया {email} पर लिखें।
{hlabel} {id} सत्यापित किया गया।
श्रीमती {hname} के नाम पर खाता है।
पता: {haddress}
नामिती {hname}, {hlabel} {id}
प्रार्थी {hname}
भवदीय,¶{hname}
गवाह {hname} ने बयान दिया।
दूरभाष {phone}
अर्जदार {hname} यांचा दूरध्वनी {phone} आहे.
श्री {hname} राहणार {haddress} यांनी अर्ज केला.
आपला विश्वासू,¶{hname}
निवेदक {hname} को फोन {phone} हो।
श्री {hname} ले {haddress} मा घर किन्नुभयो।
Mera naam {name} hai aur number {phone} hai.
Shri {name} ka pata {address} hai.
{name} ji ne {email} se likha tha."""
#: Patterns without any.
OTHERS = """The balance in account {number} was {amount} on {date}.
Account {number} is dormant.
Account no. {number} of {company}
A/c {number}
Your a/c {number} was debited by {amount}.
Loan account number {number} is overdue.
Savings account {number} at {place} branch
We have closed account {number} as you asked.
Cheque {number} for {amount} cleared.
Customer ID {number}
Consumer number {number}, bill amount {amount}
Order {number} was shipped on {date}.
{number} was credited with {amount}.
The company, upon receipt of the papers, will reply.
The holders show that then sign here and take the form.
Ten of them took the bus. Sign at the end.
Your deposit of {amount} matures on {date}.
Cheque no {number} drawn on {bank} was dishonoured.
{bank}, {place} Branch
Branch: {place}
{bank} will open a branch at {place} next year.
The registered office of {company} is in the {place} area.
{company} owes {amount} under invoice {ref}.
M/s {company}
M/s {company} has not paid the tax demanded in {ref}.
Invoice {ref} dated {date} for {amount}
GSTIN {gst}
GSTIN of {company}: {gst}
CIN: {code}
IFSC {code}
Ref: {ref}
Ref. No. {ref}, Date: {date}
Order passed in Appeal No. {ref}.
Case number {ref} stands posted to {date}.
Complaint {ref} is closed.
UTR {number} of {date}, {amount}
Txn id {number}
NEFT/{number}/{company}
UPI/{number}/{company}/payment
{date} {ref} {amount}
[{date}] {amount} {number}
Opening balance {amount}, closing balance {amount}
Total: {amount}
Page 3 of 7
Annexure B
Government of India
High Court of Judicature
Income Tax Department
Ministry of Corporate Affairs
In the Court of the District Judge
Assessment Year 2023-24
Notice under Section 143(2) of the Income Tax Act, 1961
Subject: Closure of account {number}
Subject: Reply to notice {ref}
Board of Directors
Chief Manager
Authorised Signatory
Branch Manager, {bank}
Assistant Commissioner, Ward 4
For {company}
Dear Customer,
Dear Sir,
Dear Madam,
Respected Sir/Madam,
Yours faithfully,¶Branch Manager
Regards,¶Customer Service Team
Thanks and regards, Help Desk
With best wishes, {bank}
To,¶The Branch Manager,¶{bank},¶{place} Branch
To¶{company}¶Accounts Department
Please quote {ref} in all letters.
The Managing Director of {company} has approved the scheme.
Messrs {company} and Messrs {company} have merged.
Shares of {company} were allotted at par.
Equipment worth {amount} was bought from {company}.
Salary from {company} of {amount} was received.
A sum of {amount} was paid to {company} on {date}.
Standing order to {company}, {amount}
Your card ending {number} was used at {company}.
The Learned Tribunal relied on Rule 8 of the Income Tax Rules.
Supreme Court held in Civil Appeal No. {number} of 2019 that interest is due.
Please keep your PAN and Aadhaar card ready.
Enter the phone number and email that you gave us.
The name and address on the card must match.
Bring a passport or driving licence as proof.
The passport office is closed on Monday.
Your mobile number ending {number} is registered.
Late fee of {amount} applies from {date}.
Rate of interest 7.25% p.a.
Period 01/04/2023 to 31/03/2024
Time 10:45:12
Quantity 12 at 350.00 each
Kotak Road crossing is closed for repairs.
{place} Office, Third Floor
The {place} Branch works till 4 pm.
Pay {company} through {bank}.
Mail is read once a day.
Thursday, January, Diwali and Easter are holidays.
La facture {ref} de {amount} a été réglée par {company}.
Votre compte {number} présente un solde de {amount}.
Madame, Monsieur,
Monsieur le Directeur,
La Société {company} a changé de siège.
Agence de {place}
Le Tribunal de Commerce a statué le {date}.
Die Rechnung {ref} über {amount} von {company} ist offen.
Ihr Konto {number} weist {amount} aus.
Sehr geehrte Damen und Herren,
Die Firma {company} hat ihren Sitz verlegt.
Filiale {place}
Das Amtsgericht entschied am {date}.
Mit freundlichen Grüßen¶Ihre Kundenbetreuung
खाता संख्या {number} में {amount} शेष है।
{hbank} बैंक, {hplace} शाखा
{hbank} बैंक की {hplace} शाखा में खाता है।
प्रिय ग्राहक,
महोदय,
भवदीय,¶शाखा प्रबंधक
संदर्भ: {ref}, दिनांक {date}
आयकर विभाग
जिला न्यायालय
कंपनी अधिनियम की धारा 92 के अनुसार विवरण दें।
आधार और पैन साथ लाएँ।
खाते {number} मधून {amount} वजा झाले.
प्रिय ग्राहक, {hbank} बँकेत स्वागत आहे.
खाता {number} बाट {amount} झिकियो।
Aapke account {number} se {amount} kat gaye hain.
{bank} ki {place} shakha band hai."""

_FIRST = """Aarav Aditi Ajay Amit Anjali Arjun Asha Deepak Divya Farah Gaurav Geeta Harish Imran Ishaan Jaya Karan Kavita Lakshmi Manoj Meera Mohan
Nandini Neha Nikhil Pooja Priya Rahul Rajesh Rekha Rohit Sanjay Seema Shreya Sunita Suresh Tanvi Uma Varun Vijay Yash Zoya
Antoine Camille Claire Hugo Julien Lucie Mathilde Nicolas Anke Dieter Greta Heike Jonas Klaus Lena Matthias Sabine Uwe Emily George Hannah Oliver""".split()
_LAST = """Agarwal Bajaj Banerjee Bhat Chauhan Chopra Das Desai Deshpande Fernandes Gandhi Gupta Iyer Jain Joshi Kapoor Khan Kulkarni Kumar Mehta Menon Mishra
Mukherjee Naik Nambiar Pandey Patil Pillai Prasad Rao Reddy Roy Saxena Sethi Shah Singh Sinha Srinivasan Thakur Trivedi Varma Wagh Yadav
Bernard Dubois Fontaine Girard Lefebvre Moreau Roussel Bauer Fischer Hoffmann Krause Neumann Richter Vogel Baker Clarke Hughes Turner""".split()
_TRADE = """Traders|Enterprises|Industries Ltd|Pvt. Ltd.|Private Limited|Limited|& Sons|& Co.|Brothers|Textiles|Pharma Ltd|Steel Works|Motors|Hardware Stores|Software Solutions
Constructions|Agencies|Foods|Plastics|Tools|Paints|Tyres|Toys|Footwear|Optics|Cables|Pumps|Solar|Marbles|Packaging|Printers|Sweets|Dairy|Furniture|Seeds|Chemicals|Logistics|Travels|Studios|Labs|Metals|Castings|Spices|Oils|Wines|Books|Glass Works|Lamps|Fans|Carpets|Kitchenware|Stationers|Couriers|Foundry|Ceramics
Exports LLP|LLP|Bros|Bros.|& Bros.|Agro Products|Agro|Auto Parts|Spare Parts|Cloth House|Book House|Tea House|Paper Mills|Rice Mills|Flour Mills|Cotton Mills|Press|Provision Store|General Stores|Stores|Mart|Bazaar|Cafe|Restaurant|Hotels|Tours|Realty|Infra|Power|Gas|Petroleum|Telecom|Media|Films|Energy|Capital|Securities|Insurance|Clinic|School|Trust|Foundation|Works|Industries|Group|Holdings|Finance Corporation|Hospital|Jewellers|Medicals|Cements|Electricals|Bakery|Transport Company|GmbH|SARL|AG|Consultants|Associates|Builders|Garments|Super Market""".replace("\n", "|").split("|")
_BANKS = "Bank|Bank Ltd|Bank Limited|Co-operative Bank|Small Finance Bank|Gramin Bank|Payments Bank|Sahakari Bank Ltd".split("|")
_THINGS = "Sunrise|Golden Bell|Red Fort|Evergreen|Blue Ocean|Royal|National|Universal|Star|Diamond|Himalaya|Modern|New Age|Unity|Pioneer|Metro".split("|")
_STREETS = "Station Road|Gandhi Road|Lake View Road|Church Street|Mill Lane|Ring Road|Market Street|Canal Road|Nehru Marg|Residency Road|Rose Garden|Shivaji Nagar|Ashok Nagar|Patel Colony|Green Avenue|Old Fort Road|Tank Bund Road|College Lane".split("|")
_BLOCKS = "Block B|2nd Floor|Sector 12|Near Railway Station|Opp. City Hospital|Behind Bus Stand|Phase 2|Tower A|Shanti Apartments|Sai Residency|Lakshmi Society|Wing D|1st Main|4th Cross|Near Hanuman Temple".split("|")
_TOWNS = "Pune|Nagpur|Jaipur|Indore|Kochi|Lucknow|Surat|Mysuru|Bhopal|Nashik|Chennai|Kolkata|Hyderabad|Thane|Patna|Rampur|Shantipur|Madhavnagar|Westfield|Laxmipur".split("|")
_HFIRST = "राम सीता अमित अनिता सुनील सुनीता राजेश रेखा मोहन मीना विजय विमला अजय आशा संजय सरिता दीपक गीता प्रकाश पूजा नरेश कमला हरि राधा कृष्ण लता".split()
_HLAST = "शर्मा वर्मा गुप्ता सिंह यादव मिश्रा पाटील जोशी देशमुख कुलकर्णी थापा अधिकारी पौडेल श्रेष्ठ मेहता जैन अग्रवाल चौहान तिवारी पवार गायकवाड दुबे".split()
_HTOWNS = "पुणे नागपुर जयपुर इंदौर लखनऊ भोपाल पटना काठमांडू नासिक रामपुर".split()
_HSTREETS = "गांधी मार्ग|स्टेशन रोड|नेहरू नगर|शिवाजी चौक|मुख्य बाज़ार|अशोक नगर|नदी किनारा".split("|")
_DEVANAGARI = str.maketrans("0123456789", "०१२३४५६७८९")
#: Sentences made by rule, by language: words that lead to a person, roles and titles before a name, and what may follow it;
#: what else the same words lead to.
_LEADS = {
    "en": "||The|Our|A|Please contact the|Then the|This|Letter to the|Papers of the|Parcel for|Please contact|Kindly call|Write to|We met|Sent to|Given by|Signed by|Return it to|Copy to|I spoke to|Cheque in favour of|Money from|Account of|Notice to|Message for|Application of",
    "fr": "||Le|La|Notre|Veuillez contacter|Merci d’appeler|Lettre à|Remis par|Signé par|Le dossier de|Pour|Écrire à",
    "de": "||Der|Die|Unser|Bitte rufen Sie|Schreiben an|Unterlagen von|Bitte wenden Sie sich an|Unterschrieben von|Für|Antrag von",
    "hi": "||यह|कृपया|हमारे|पत्र|आज|तब",
}
_ROLES = {
    "en": "account holder|holder|depositor|customer|borrower|applicant|nominee|payee|drawer|guarantor|deponent|petitioner|respondent|complainant|witness|director|proprietor|partner|trustee|officer|tenant|landlord|advocate|employee|passenger|patient|student|Mr.|Mrs.|Ms.|Mr|Mrs|Ms|Miss|Dr.|Dr|Prof.|Shri|Sri|Smt.|Smt|Kum.|Adv.|Capt.||||",
    "fr": "titulaire|client|cliente|demandeur|témoin|bénéficiaire|locataire|M.|Mme|Mlle|Monsieur|Madame|Dr|Maître||",
    "de": "Inhaber|Kontoinhaber|Kunde|Kundin|Antragsteller|Zeuge|Mieter|Herr|Herrn|Frau|Dr.||",
    "hi": "खाताधारक|ग्राहक|आवेदक|नामिती|गवाह|याचिकाकर्ता|श्री|श्रीमती|सुश्री|डॉ.|कर्मचारी|",
}
_DOES = {
    "en": "lives at {address}|resides at {address}|residing at {address}|of {address} agreed|has {label} {id}|holds {label} {id}|showed {label} {id} at the desk|can be reached on {phone}|on {phone}|at {phone}|called from {phone}|wrote from {email}|with {email}|was present|came with a form|gave us a copy|gave {label} {id}|brought {label} {id}|told us|asked for it|has asked|did not reply|signed on {date}|paid {amount}|and {name} came|is old|said so|, {label} {id}, is known|; phone {phone}|: {phone}|, {address}|for help|at once|",
    "fr": "habite au {address}|réside {address}|demeure {address}|au {phone}|est joignable au {phone}|a écrit de {email}|a signé le {date}|présente le passeport {id}|, {address}|était là|",
    "de": "wohnt in {address}|, {address}|unter {phone}|hat die Nummer {phone}|schrieb von {email}|unterschrieb am {date}|zeigte den Pass {id}|war da|an|",
    "hi": "का पता {haddress} है|{haddress} में रहते हैं|का फ़ोन {phone} है|को {phone} पर बुलाएँ|ने {hlabel} {id} दिखाया|ने {date} को लिखा|ने आवेदन किया|का ईमेल {email} है|आए थे|",
}
_INSTEAD = {
    "en": "must sign here|of {company} resigned|{company}|{bank}|of {bank}|the {place} branch|will pay {amount}|has account {number}|in case {ref}|is asked to reply by {date}|and the bank agreed",
    "fr": "doit signer|de {company} a répondu|{company}|la {bank}|l’agence de {place}|paiera {amount}|a le compte {number}",
    "de": "muss unterschreiben|der {company} antwortete|{company}|die {bank}|die Filiale {place}|zahlt {amount}|hat das Konto {number}",
    "hi": "को हस्ताक्षर करना होगा|{hbank} बैंक|की {hplace} शाखा|{amount} देगा|का खाता {number} है|से {date} तक उत्तर माँगा गया है",
}


class Maker:
    """Made-up values, drawn from ``rng``."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.makers: dict[str, tuple[Callable[[], str], str | None]] = {
            "name": (self.name, "name"), "hname": (self.hname, "name"), "phone": (self.phone, "phone"), "email": (self.email, "email"), "id": (self.ident, "id_number"),
            "address": (self.address, "address"), "haddress": (self.haddress, "address"), "label": (self.label, None), "hlabel": (self.hlabel, None), "company": (self.company, None),
            "bank": (self.bank, None), "hbank": (lambda: self.pick(_HFIRST + _HTOWNS), None), "place": (lambda: self.pick([*_STREETS, *_TOWNS, *_STREETS]), None), "hplace": (lambda: self.pick([*_HTOWNS, *_HSTREETS]), None),
            "amount": (self.amount, None), "number": (self.number, None), "date": (self.date, None), "ref": (self.ref, None), "code": (self.code, None), "gst": (self.gst, None),
        }
        self.people: list[tuple[str, str]] = []

    def rule(self, person: bool) -> str:
        """A pattern made by rule, with a person or without any."""
        lang = self.pick(["en", "en", "en", "fr", "de", "hi"])
        one = lambda table: self.pick(table[lang].split("|"))
        name = ("{hname}" if lang == "hi" else "{name}") if person else ""
        role = one(_ROLES) if self.rng.random() < 0.65 else ""
        if lang != "hi" and self.rng.random() < (0.1 if person else 0.5):
            role = " ".join(self.lower("") for _ in range(int(self.rng.integers(1, 3))))
        x = " ".join(w for w in (one(_LEADS), role, name, one(_DOES) if person else one(_INSTEAD)) if w)
        x = re.sub(r" (?=[,;:])", "", x)
        return x + self.pick(["।", " ।", "."] if lang == "hi" else [".", ".", ""])

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def digits(self, n: int) -> str:
        return "".join(str(int(x)) for x in self.rng.integers(0, 10, n))

    def letters(self, n: int) -> str:
        return "".join(chr(65 + int(x)) for x in self.rng.integers(0, 26, n))

    def word(self) -> str:
        """A name that is no known one: two to four syllables."""
        heads = "b bh ch d dh f g gh h j k kh l m n p ph r s sh t th v w y z br kr pr sr tr st".split()
        tails = ["", "", "n", "r", "l", "t", "sh", "k", "m", "s", "nd", "tt"]
        x = "".join(self.pick(heads) + self.pick("aaeiiou") for _ in range(int(self.rng.integers(1, 4)))) + self.pick(tails)
        return x.title() if len(x) > 2 else (x + "na").title()

    def person(self) -> tuple[str, str]:
        made = self.rng.random() < 0.6
        first = self.word() if made else self.pick(_FIRST)
        last = self.word() if self.rng.random() < 0.6 else self.pick(_LAST)
        if self.rng.random() < 0.06:
            last = f"{last}-{self.pick(_LAST)}" if self.rng.random() < 0.6 else self.pick(["D'", "O'"]) + last
        return first, last

    def name(self) -> str:
        known = self.people and self.rng.random() < 0.35
        first, last = self.pick(self.people) if known else self.person()
        self.people.append((first, last))
        k = int(self.rng.integers(16))
        if known and k < 4:
            return last if k < 3 else first
        x = (
            f"{first} {self.pick('ABDGJKLMNPRSTV')}. {last}" if k < 5 else f"{self.pick('ABDGJKLMNPRSTV')}. {last}" if k < 7 else f"{last.upper()}, {first}" if k < 9
            else f"{self.pick('ABKMRS')}. {self.pick('ABKMRS')}. {last}" if k == 9 else f"{first} {last}"
        )
        return x.upper() if k == 10 else x.lower() if k == 11 and self.rng.random() < 0.5 else x

    def hword(self) -> str:
        heads, signs = "क ख ग च ज त द ध न प फ ब भ म य र ल व श स ह".split(), ["", "", "ा", "ि", "ी", "ु", "े", "ो"]
        return "".join(self.pick(heads) + self.pick(signs) for _ in range(int(self.rng.integers(2, 5))))

    def hname(self) -> str:
        first = self.hword() if self.rng.random() < 0.5 else self.pick(_HFIRST)
        middle = f" {self.pick(['कुमार', 'देवी', 'प्रसाद', 'बहादुर'])}" if self.rng.random() < 0.15 else ""
        return f"{first}{middle} {self.hword() if self.rng.random() < 0.5 else self.pick(_HLAST)}"

    def phone(self) -> str:
        n = self.pick("56789") + self.digits(9)
        k = int(self.rng.integers(12))
        if k < 9:
            cut = self.pick([(10,), (10,), (5, 5), (5, 5), (3, 3, 4), (4, 3, 3), (2, 4, 4), (4, 6)])
            sep, at, groups = self.pick(" -."), 0, []
            for c in cut:
                groups.append(n[at : at + c])
                at += c
            code = self.pick(["", "", "", "+91", "+91", "0091", "0091", "0", "91", "+44", "+1"])
            x = code + ("" if code in ("", "0") else self.pick(["", " ", "-"])) + sep.join(groups)
            if len(cut) == 3 and not code and self.rng.random() < 0.4:
                x = f"({groups[0]}) {groups[1]}-{groups[2]}"
        else:
            x = self.pick(
                [f"022-{n[:8]}", f"0{n[:3]}-{n[3:6]} {n[6:]}", f"1800 {n[:3]} {n[3:7]}", f"1800-{n[:3]}-{n[3:7]}", f"+33 {n[0]} {n[1:3]} {n[3:5]} {n[5:7]} {n[7:9]}", f"0{n[0]} {n[1:3]} {n[3:5]} {n[5:7]} {n[7:9]}",
                 f"+49 {n[:3]} {n[3:]}", f"+49 30 {n[:7]}", f"+49 40 {n[:5]} {n[5:8]}", f"0{n[1:3]}/{n[3:]}", f"+44 20 {n[:4]} {n[4:8]}"]
            )
        return x.translate(_DEVANAGARI) if self.rng.random() < 0.07 else x

    def email(self) -> str:
        first, last = (x.lower().replace("'", "") for x in self.person())
        user = self.pick([f"{first}.{last}", f"{first}{self.digits(2)}", f"{first[0]}{last}", f"{first}_{last}", last, "info", "support", "care.desk", f"{first}-{last}{self.digits(1)}", f"{first}+mail", f"{first}{self.digits(3)}", f"{first}_{self.digits(2)}"])
        host = self.pick(["example", last, "mailbox", "webpost"]) + self.pick([".com", ".org", ".net", ".in", ".co.in", ".example", ".test"])
        k = int(self.rng.integers(10))
        if k == 0:
            return f"{user} AT {host.replace('.', ' DOT ')}"
        if k == 1:
            return f"{user} [at] {host.replace('.', ' [dot] ')}"
        return f"{user}(at){host}" if k == 2 else f"{user} (at) {host}" if k == 3 else f"{user}@{host}"

    def ident(self) -> str:
        d, l = self.digits(13), self.letters
        x = self.pick(
            [f"{l(5)}{d[:4]}{l(1)}", f"{l(5)}{d[:4]}{l(1)}", f"{l(5)} {d[:4]} {l(1)}", f"{l(5)}{d[:4]}{l(1)}".lower(), d[:12], f"{d[:4]} {d[4:8]} {d[8:12]}", f"{d[:4]} {d[4:8]} {d[8:12]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}",
             f"{l(3)}{d[:7]}", f"{l(1)}{d[:7]}", f"{l(1)}{d[:8]}", f"{l(2)}{d}", f"{l(2)}{d[:2]}-{d[2:]}", f"{l(2)}{d[:2]} {d[2:]}"]
        )
        return x.translate(_DEVANAGARI) if self.rng.random() < 0.05 else x

    def address(self) -> str:
        n, k = self.digits(int(self.rng.integers(1, 4))), int(self.rng.integers(12))
        if k == 0:
            street = self.pick(["Gare", "Marché", "Écoles", "Pasteur", "Victor Hugo", "Vieux Pont", "Quatre Vents"]) if self.rng.random() < 0.3 else " ".join(self.word() for _ in range(int(self.rng.integers(1, 3))))
            return f"{n}{self.pick(['', ',', ' bis'])} {self.pick(['rue', 'rue', 'avenue', 'place', 'chemin', 'boulevard', 'allée'])} {self.pick(['de la ', 'des ', 'du ', 'de ', ''])}{street}, {self.digits(5)} {self.pick(['', '', 'Saint-'])}{self.word()}"
        if k == 1:
            street = self.word() + self.pick(["straße", "weg", "gasse", "platz", "allee", "strasse", " Straße"]) if self.rng.random() < 0.8 else self.pick(["Am ", "Im ", "An der ", "Zum "]) + self.word()
            return f"{street} {n}{self.pick(['', '', 'a'])}, {self.digits(5)} {self.word()}{self.pick(['', 'hausen', 'stadt', 'heim', 'burg'])}"
        number = self.pick([n, n, f"{n}/{self.pick('ABCD')}", f"{n}-{self.digits(1)}", f"{self.pick('ABCD')}-{n}", f"{n}{self.pick('ABCD')}"])
        kind = self.pick(["", "", "Flat", "House", "Plot", "Shop", "Door", "Room", "Unit", "Apartment", "Office", "Villa", "H."])
        house = f"{kind}{self.pick([' ', ' No ', ' No. ', ' no. ', ' #']) if kind != 'H.' else 'No. '}{number}" if kind else self.pick(["", "", "#"]) + number
        town = self.pick(_TOWNS) if self.rng.random() < 0.6 else self.word() + self.pick(["pur", "nagar", "wadi", "ganj", "abad", "", " City"])
        street = self.pick(_STREETS) if self.rng.random() < 0.6 else f"{self.word()} {self.pick(['Road', 'Street', 'Lane', 'Nagar', 'Marg', 'Chowk', 'Park', 'Market'])}"
        block = self.pick(_BLOCKS) if self.rng.random() < 0.6 else f"{self.word()} {self.pick(['Apartments', 'Society', 'Heights', 'Towers', 'Residency', 'Complex'])}"
        parts = [f"{house} {street}"] if k == 2 else [house] + ([block] if self.rng.random() < 0.6 else []) + ([street] if self.rng.random() < 0.8 else [])
        pin = self.digits(6) if self.rng.random() < 0.8 else f"{self.digits(3)} {self.digits(3)}"
        return ", ".join(parts) + f", {town}{self.pick([' ', '-', ' - ', ', PIN ', ', ', ' PIN '])}{pin}"

    def haddress(self) -> str:
        house = self.pick([f"मकान नं. {self.digits(2)}", f"मकान {self.digits(3)}", f"फ्लैट {self.digits(3)}", f"{self.digits(2)}/{self.pick('कखग')}", f"घर नं {self.digits(2)}", f"प्लॉट {self.digits(2)}"])
        town = self.pick(_HTOWNS) if self.rng.random() < 0.5 else self.hword()
        return f"{house}, {self.pick(_HSTREETS) if self.rng.random() < 0.6 else self.hword() + self.pick([' मार्ग', ' नगर', ' गली', ' रोड'])}, {town}{self.pick([' ', ' - ', '-'])}{self.digits(6)}"

    def sep(self) -> str:
        return self.pick(["", "", ":", " -", " :", ".:"])

    def label(self) -> str:
        return self.pick(["PAN", "PAN", "pan", "PAN no.", "PAN No", "Permanent Account Number", "Aadhaar", "Aadhaar No.", "aadhaar number", "UID", "Voter ID", "voter card", "EPIC No.", "EPIC", "passport", "Passport No", "Driving Licence", "driving license no.", "DL No.", "DL", "identity card"]) + self.sep()

    def hlabel(self) -> str:
        return self.pick(["पैन", "पैन नंबर", "आधार", "आधार संख्या", "मतदाता पहचान पत्र", "पासपोर्ट", "पासपोर्ट संख्या", "ड्राइविंग लाइसेंस"]) + self.sep()

    def company(self) -> str:
        noun = self.pick(["", "", self.lower(self.pick(["s", "ets", "ers", "ing", "ics", "wares", "tions"])).title()])
        head = self.pick([self.word(), self.pick(_LAST), self.pick(_THINGS), f"{self.pick(_THINGS)} {self.word()}", f"{self.word()} {self.pick(_THINGS)}", self.person()[1], f"{self.lower('').title()} {self.lower('').title()}"])
        if self.people and self.rng.random() < 0.2:
            head = self.pick(self.people)[1]
        x = f"{head} {noun or self.pick(_TRADE)}" + (f" {self.pick(_TRADE)}" if noun and self.rng.random() < 0.6 else "")
        x += self.pick([""] * 8 + [" (India)", " (India) Ltd", ", Inc."])
        return x.upper() if self.rng.random() < 0.05 else x

    def lower(self, end: str) -> str:
        """A word in small letters that is no known one."""
        return "".join(self.pick("bcdfghlmnprstvw") + self.pick(["a", "e", "i", "o", "u", "ea", "or", "en", "al"]) for _ in range(int(self.rng.integers(1, 4)))) + (end or self.pick("nrtlsk"))

    def vary(self, text: str, often: float = 0.2) -> str:
        """``text`` with some of its words replaced by unknown ones with the same ending, so that a word isn't taken for a name
        because it is new."""
        out = []
        for w in re.split(r"(\s+)", text):
            if self.rng.random() < often and re.fullmatch(r"[A-Za-z]?[a-z]{3,}[.,:;]?", w) and (w[0].islower() or not out or out[-2:-1] and out[-2][-1:] in ".?!"):
                m = re.fullmatch(r"([A-Za-z]+?)([a-z]{0,3})([.,:;]?)", w)
                new = self.lower(w.rstrip(".,:;")[-int(self.rng.integers(1, 4)) :]) + m[3]
                w = new.title() if w[0].isupper() else new
            out.append(w)
        return "".join(out)

    def bank(self) -> str:
        return f"{self.pick([self.word(), self.pick(_TOWNS), self.pick(_THINGS)])} {self.pick(_BANKS)}" if self.rng.random() < 0.8 else f"Bank of {self.word()}"

    def amount(self) -> str:
        n = self.pick([f"{self.digits(1)},{self.digits(2)},{self.digits(3)}.{self.digits(2)}", f"{self.digits(2)},{self.digits(3)}", f"{self.digits(3)}.{self.digits(2)}", f"{self.digits(3)}/-", f"{self.digits(4)}"])
        return self.pick(["Rs. ", "Rs ", "₹", "₹ ", "INR ", "€ ", ""]) + n

    def number(self) -> str:
        return self.pick([self.digits(12), self.digits(11), self.digits(10), self.digits(10), self.digits(9), self.digits(14), self.digits(16), self.digits(6), "X" * 6 + self.digits(4), "*" * 4 + self.digits(4), "XX" + self.digits(4)])

    def date(self) -> str:
        d, m, y = f"{int(self.rng.integers(1, 29)):02d}", f"{int(self.rng.integers(1, 13)):02d}", f"20{self.digits(2)}"
        return self.pick([f"{y}-{m}-{d}", f"{d}/{m}/{y}", f"{d}-{m}-{y}", f"{d}.{m}.{y[2:]}", f"{d} March {y}", f"{d} Jan {y}"])

    def ref(self) -> str:
        l, d = self.letters, self.digits
        return self.pick([f"{l(2)}{d(8)}", f"{l(3)}/{d(4)}/20{d(2)}", f"{l(2)}-{d(6)}", f"{l(4)}{d(10)}", f"{d(3)}/20{d(2)}", f"{l(1)}{d(9)}", f"{l(3)}/20{d(2)}-{d(2)}/{d(5)}"])

    def code(self) -> str:
        return self.pick([f"{self.letters(4)}0{self.digits(6)}", f"{self.letters(4)}{self.digits(12)}", f"U{self.digits(5)}{self.letters(2)}20{self.digits(2)}PTC{self.digits(6)}"])

    def gst(self) -> str:
        return f"{self.digits(2)}{self.letters(5)}{self.digits(4)}{self.letters(1)}1Z{self.pick('123456789ABC')}"

    def fill(self, pattern: str) -> list[tuple[str, str | None]]:
        """(text, entity type) pieces of one sentence made from ``pattern``."""
        out: list[tuple[str, str | None]] = []
        rest = pattern
        while rest:
            head, brace, tail = rest.partition("{")
            if head:
                out.append((head.replace("¶", "\n"), None))
            if not brace:
                break
            slot, _, rest = tail.partition("}")
            make, kind = self.makers[slot]
            out.append((make(), kind))
        return out

