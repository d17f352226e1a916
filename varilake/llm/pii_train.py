"""Training of the field in pii: everyday texts written from forms, a bounded sample of labelled documents, and the fit.

    python -m varilake.llm.pii_train DOCUMENTS.parquet OUT.json

The everyday texts (mails, chats, letters, forms, reports, notes, tables, in three languages) come from forms with slots.
A slot gives a random value; those in LABELLED are entities, all others are look-alikes: firms, towns, dates, sums, order,
flight and serial numbers, given names alone, initials alone, redactions. Half of the names are common ones, half are
random letters, so that the weights rest on contexts as well.

The documents are those that pii_labels.json lists, at most SAMPLE of them: places of their entities, found by an earlier
tagger, read through by hand and corrected. Of every five documents the last is held out from the fit.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from varilake.llm.pii import LABELS, LINKS, PRUNE, REACH, ROUNDS, Edges, Tagger, canonical, chain, features, in_buckets, spoken, tokens_of

TEXTS = 5_000
"""Bound on the everyday texts that the field is fitted to."""
SAMPLE = 2_400
"""Bound on the labelled documents that are read."""
SEED = 11
OWN = ("cap", "pre", "len=", "suf")
"""Features of how a word is written that only count for the word itself, not for its neighbours."""
LEXICAL = ("w=", "cap", "pre", "suf")
"""Features that depend on the letters of a word."""
QUIET = 3
"""Of the runs of tokens without an entity, one in so many is fitted to; in use, all tokens are labelled."""
LABEL_FILE = Path(__file__).with_name("pii_labels.json")

# fixed values: common names, streets and towns
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Paul Ashley Steven Emily Andrew "
    "Kimberly Joshua Michelle Kevin Laura Brian Amanda George Melissa Edward Rebecca Ronald Sharon Timothy Cynthia Anna Lukas Leonie Felix Jonas Greta Heike Jürgen Sabine Uwe Petra Wolfgang Claudia Stefan Katrin Dieter Monika Pierre "
    "Camille Luc Chloé François Amélie Jean Hélène Nicolas Mathilde Antoine Élise Giulia Marco Sofia Diego Carmen Luis Ahmed Fatima Omar Leila Priya Arjun Mei Wei Yuki Kenji Olga Ivan Ewa Piotr Ingrid Lars Nadia Tariq"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Perez Thompson White Harris Clark Ramirez Lewis Robinson Walker Young Allen King "
    "Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Richter Klein Wolf Neumann Schwarz "
    "Braun Hofmann Krüger Merkel Dubois Moreau Laurent Lefebvre Roux Fournier Girard Bonnet Lambert Rousseau Rossi Ferrari Silva Santos Costa Kowalski Nowak Novak Petrov Ivanova Hansen Larsen Khan Patel Singh Sharma Chen Wang Tanaka Suzuki Kim"
).split()
STREET = "Elm Oak Maple Cedar Pine Washington Lincoln Jefferson Park Lake Hillcrest Sunset Victoria Station King Queen George Pennsylvania Massachusetts Baker Abbey Highland Franklin Spruce River Union Spring Broad Chestnut Dogwood Meadow Orchard School Grove College Prospect Walnut Juniper Willow Magnolia".split()
WAY = "Street Road Avenue Lane Drive Court Boulevard Way Place Terrace Crescent St Rd Ave Dr Blvd Close Row Square Hill".split()
STREET_DE = ["Hauptstraße", "Schillerstraße", "Goethestr.", "Kirchplatz", "Rosenweg", "Am Bahnhof", "Unter den Linden", "Lange Gasse", "Parkallee", "An der Kirche", "Wiesenstraße", "Zum Hafen", "Beethovenring", "Dorfstraße", "Kaiserdamm", "Feldweg", "Im Winkel"]
STREET_FR = ["rue Victor Hugo", "avenue des Champs", "boulevard Voltaire", "rue de l'Église", "place de la République", "allée des Tilleuls", "rue du Moulin", "chemin des Vignes", "quai de Seine", "impasse du Lavoir", "rue Pasteur", "cours Lafayette"]
TOWN = "London Berlin Paris Boston Hamburg Lyon Chicago Vienna Madrid Denver Dublin Leeds Munich Zurich Toronto Austin Bristol Nantes Oslo Lisbon Cologne Seattle Glasgow Geneva Milan Portland".split()
FIRM = ["Acme", "Globex", "Initech", "Umbrella", "Stark", "Wayne", "Hooli", "Vandelay", "Northwind", "Contoso", "Blue Sky", "Sunrise", "Alpine", "Riverbank", "Delta", "Phoenix"]
FIRM_END = ["Inc.", "Corp", "Ltd", "LLC", "GmbH", "AG", "Bank", "Airlines", "Hospital", "University", "Logistics", "Insurance", "Hotel", "& Sons", "Partners", "Foundation", "S.A."]
HOST = ["gmail.com", "yahoo.com", "outlook.com", "web.de", "gmx.net", "orange.fr", "company.co.uk", "mail.university.edu", "bundestag.de", "shop.io", "hotmail.fr", "proton.me", "city-council.gov", "my-isp.net"]
REDACTIONS = ["[removed]", "[NAME]", "***", "████", "<redacted>", "XXX", "N.N.", "J.", "[anonymisiert]", "[caviardé]", "________", "A.B."]

LABELLED = {"N": "name", "S": "name", "A": "address", "D": "address", "F": "address", "P": "phone", "I": "id_number", "E": "email"}

# N full name, S surname alone, A D F addresses in English, German, French, P phone, I identity number, E mail
EN = r"""
Hi {G}, quick note that {N} will join us on {DAY}.|Please call {N} on {P} before {TIME}.|You can reach me at {P} or {E}.|My number is {P}.|My new number is {P}, the old one no longer works.|Tel: {P}|Phone: {P}|Mobile: {P}|Fax: {P}|T {P}
Email: {E}|E-mail: {E}|Write to {E} if anything is unclear.|cc: {E}, {E}|From: {N}|From: {N} <{E}>|To: {N} <{E}>|Best regards,\n{N}|Kind regards\n{N}\n{ORG}|Thanks, {G}|Sincerely,\n\n{N}\n{ROLE}, {ORG}|Dear {TITLE} {S},|Dear {N},|Dear all,|Hello {G},|Yours, {G}
Name: {N}|Full name: {N}|Patient: {N}|Emergency contact: {N}, {P}|Next of kin: {N} ({P})|Address: {A}, {TOWN}|Home address: {A}|Deliver to {A}, {TOWN} {ZIP}.|She lives at {A} in {TOWN}.|He moved from {A} to {A} last {MONTH}.|We met at {A}, right behind the station.|The flat at {A} is for rent.
The house, {A}, was sold to {N}.|Ship to: {N}, {A}, {TOWN}|Passport {I}|Passport no. {I}|Passport number: {I}|SSN: {I}|His social security number is {I}.|Her social security number was printed as {I} on the form.|National Insurance number {I}|Tax ID {I}|Taxpayer number {I}|Identity card {I}|ID card no. {I}|Driver's licence {I}|Personal number {I}
My tax id is {I}, please file it.|Social insurance: {I}|{N} (passport {I}) boarded in {TOWN}.|{N}, tax number {I}, owes nothing.|{TITLE} {S} will see you at {TIME}.|{TITLE} {S}'s office is on floor {d}.|Ask {TITLE} {S} or {TITLE} {S} about it.|I spoke with {TITLE} {S} yesterday.|The report by {N} and {N} is attached.|Photo: {N}
Attendees: {N}; {N}; {N}|Present: {TITLE} {S}, {TITLE} {S}|Interview with {N}|{N} wrote:|{N} said the invoice was late.|{N} asked whether {N} had paid.|According to {N}, it rained all {DAY}.|My neighbour {N} saw it.|The driver, {N}, called an ambulance.|Our manager {N} is away until {DATE}.|Signed: {N}|Witnessed by {N}|Prepared by {N}, {ROLE}
{ROLE}: {N}|Contact: {N}, {E}, {P}|For details contact {N} ({E}).|Guest speaker is {N} from {ORG}.|{N} joined {ORG} as {ROLE} in {Y}.|{N} and {N} were married in {TOWN}.|{N} was born in {TOWN} on {DATE}.|In memory of {N}|Coach {S} praised the team.|President {S} spoke for an hour.|Nurse {S} gave the injection at {TIME}.|Officer {S} took the statement.|Professor {S} taught chemistry.
{TOWN} is lovely in {MONTH}.|I love {TOWN} and {TOWN}.|{ORG} opened a branch in {TOWN}.|Order {CODE} has shipped.|Order no. {n8} has shipped.|Tracking number {n12}|Invoice {n8} is due on {DATE}.|Invoice no. {CODE}|Your ticket is {CODE}.|Flight {L}{L} {n3} leaves at {TIME}.|Room {n3}, floor {d}.|Version {d}.{d}.{n} fixes the bug.|ISBN {n3}-{d}-{n4}-{n4}-{d}
The total is ${n},{n3}.{n2}.|It costs {n} euros.|About {n} people came, {n} of them by train.|Population: {n},{n3}|Chapter {n}, page {n3}|See section {d}.{d} for more.|Opening hours: {TIME} to {TIME}|Meeting on {DATE} at {TIME}.|{DAY} {d} {MONTH} {Y}|The {ST} bus stop is closed.|{ST} was blocked by snow.|Turn left into {ST} and park there.|Lake {S0} is frozen.|Mount {S0} is {n4} m high.
{S0} {FE} reported a loss.|The {S0} Foundation paid for it.|{S0} Airport was closed for {n} hours.|Upper {S0} and Lower {S0} are villages.|{S0} County voted on {DAY}.|{G} is late again.|Happy birthday {G}!|{G}, can you check row {n}?|The {ROLE} of {ORG} resigned.|{REDACTED} did not reply.|Witness {REDACTED} saw nothing.|The letter from {REDACTED} was lost.|Reach {REDACTED} at {REDACTED}.|Customer no. {n8}|Company number {n8}|Case {n4}/{n2}
Registered in {TOWN} under company no. {n8}.|Serial number {CODE}{n4}|Account {n4} was closed.|Score: {n}-{n}|Add {n} g of flour and {d} eggs.|We sold {n} tickets @ ${n} each.|Monday, Tuesday and Friday are taken.|I agree.|That works for me.|Let me know what you think.|Sounds good, see you then.|No problem at all.|Thank you for your patience.|This was discussed at length.|Nothing was decided.|The weather stayed dry.
- {N}\n- {N}\n- {N}|1. {N}\n2. {N}|{N}\t{P}\t{E}|{N}; {A}; {P}|{NU}\n{A}\n{TOWN} {ZIP}|{N} v. {ORG}|{N} against {N}|{N} and {ORG}, jointly|Both {N} and {N} left early.|Neither {N} nor {TITLE} {S} answered.|I handed {N} the keys.|The parcel went to {N}'s mother.|With {N} on stage the hall was full.
""".strip()  # fmt: skip
DE = r"""
Sehr geehrte Frau {S},|Sehr geehrter Herr {S},|Liebe {G},|Hallo {G}, bis {DAYDE}.|Mit freundlichen Grüßen\n{N}|Viele Grüße\n{G}|Herr {S} ist heute nicht im Büro.|Frau {S} ruft zurück.|Bitte rufen Sie {N} unter {P} an.|Telefon: {P}|Handy {P}|Meine Nummer ist {P}.|Schreiben Sie an {E}.|E-Mail: {E}|Er wohnt {D} in {TOWN}.|Anschrift: {D}, {ZIP} {TOWN}
Sie ist in die {D} gezogen.|Lieferung an {N}, {D}.|Personalausweis {I}|Ausweisnummer: {I}|Steuernummer {I}|Steuer-ID {I}|Die Sozialversicherungsnummer lautet {I}.|Reisepass Nr. {I}|Die Patientin {N} wurde entlassen.|Der Fahrer {N} blieb unverletzt.|{N}, geboren am {d}.{d}.{Y}, lebt in {TOWN}.|Die Rechnung {n8} ist bezahlt.|Die Firma {ORG} hat {n} Mitarbeiter.|Am {d}. {MONTHDE} {Y} begann der Umbau.
Kundennummer {n8}|Das Spiel endete {d}:{d}.|{TOWN} liegt am Wasser.|Die Sitzung dauerte {n} Minuten.|Das kostet {n},{n2} Euro.|Der Zug fährt um {TIME} ab.|Vielen Dank für Ihre Nachricht.|Dem ist nichts hinzuzufügen.|Die Haltestelle {STDE} ist gesperrt.|Zuständig ist {N}.|Ansprechpartner: {N}, Tel. {P}|{REDACTED} hat nicht geantwortet.|Dr. {S} und Prof. {S} waren anwesend.|Die Gemeinde {S0} plant einen Park.
""".strip()  # fmt: skip
FR = r"""
Madame {S},|Monsieur {S} est absent.|Chère {G}, à {DAYFR} !|Cordialement,\n{N}|Bien à vous, {G}|Tél. : {P}|Téléphone {P}|Appelez {N} au {P}.|Mon numéro est le {P}.|Écrivez à {E}.|Courriel : {E}|Elle habite {F} à {TOWN}.|Adresse : {F}, {ZIP} {TOWN}|Livrer à {N}, {F}.|Passeport n° {I}|Carte d'identité {I}|Numéro de sécurité sociale : {I}|Numéro fiscal {I}|Mme {S} rappellera demain.|M. {S} a signé.
Le docteur {S} est en congé.|La patiente {N} est sortie.|{N} est né à {TOWN} en {Y}.|La société {ORG} recrute.|La facture {n8} est réglée.|Le train part à {TIME}.|Cela coûte {n},{n2} euros.|Le {d} {MONTHFR} {Y}, tout a changé.|{TOWN} est une belle ville.|Commande n° {CODE}|Merci pour votre message.|Rien n'a été décidé.|La {STFR} est fermée.|Présents : {N} ; {N}|Responsable : {N}|{REDACTED} n'a pas répondu.|Le lac de {S0} est gelé.
""".strip()  # fmt: skip
# forms whose words are drawn at random, so that a value is also known without a cue
LOOSE = r"""
{WU} {W} {N} {W} {W}.|{N} {W} {W} {W}.|{WU} {W} {W} {N}.|{W} {N} {W} {N} {W}|{N} {W} {N} {W} {W}.|{WU} {W} {TITLE} {S} {W} {W} {TITLE} {S} {W}.|{WU} {TITLE} {S} {W}.|{TITLE} {S} {W} {W}.|{TITLE} {S} {W}.|{W} {TITLE} {S} {W}|{WU} {W} {W} {TITLE} {S}.|{TITLE} {S} {W} {W} {W} {TITLE} {S} {W} {W} {W}.|{TITLE} {S}, {W} {W}.|{WU} {W} {TITLE} {S} {W} {W} {W}?|{WU} {W} {W} {N} {W} {W} {W}.|{WU} {W} {N}.|{N} {W}.|{WU} {W} {E} {W}, {W} {E} {W}.|{WU} {E} {W}.|{W} {W} {E}|{WU} {W} {P} {W} {W}.|{WU} {W} {P}.|{W} {P} {W}|{WU} {W} {A}, {W} {W}.|{A} {W} {W}.|{W} {W} {A} {W}
{WU} {W} {D} {W}.|{WU} {W} {F} {W}.|{WU} {TOWN} {W} {W} {TOWN}.|{TOWN} {W} {W}.|{WU} {W} {ORG} {W}.|{ORG} {W} {W}.|{WU} {W} {n8} {W}.|{WU} {W} {n4} {W}.|{WU} {CODE} {W}.|{WU} {G} {W} {W}.|{WU}, {N}, {W} {W} {W}.|{WU} {W}, {N}, {W}.|{WU} {ST} {W}.|{WU} {W} {n} {W} {n3} {W}.|{WU} {W} {W} {W}.|{WU} {W} {MONTH} {W} {DAY}.|{W} {N} ({W} {W})|{WU} {W} {W} {W} {W} {W}, {W} {W}.
""".strip()
COMMON = (
    "the and with from that will have this about would there their what when make like time just know take people into year good some could them see other than then now look only come over think also back after use two how our work first "
    "well way even new want because any these give day most us is was are be been has had did does said went asked told called found left thanked bought sold paid met saw heard knew felt kept began showed wrote stood lost sent built "
    "der die das und mit von dass wird haben über wenn machen nur auch nach gut kommt sagte fand kaufte schrieb heute gestern le la les et avec pour que sera fait dans mais plus très hier demain trouva acheta vendit"
).split()
LANGUAGES = ([x.replace("\\n", "\n").replace("\\t", "\t") for x in re.split(r"(?<! )\|(?! )|\n", text)] for text in (EN, DE, FR, LOOSE))


class Writer:
    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.forms = list(FORMS)

    def made_up(self) -> str:
        word = "".join(self.r.choice(["b", "br", "c", "ch", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "w", "z"]) + self.r.choice("aeiouy") for _ in range(self.r.randint(1, 3)))
        word += self.r.choice(["n", "r", "s", "k", "l", "", "th", "ck", "rd", "lle", "tz", "sen", "ski", "man"])
        if self.r.random() < 0.08:
            word = re.sub("[eaou]", lambda m: {"e": "é", "a": "á", "o": "ö", "u": "ü"}[m[0]], word, count=1)
        return word.capitalize()

    def word(self) -> str:
        return self.r.choice(COMMON) if self.r.random() < 0.7 else self.made_up().lower()

    def person(self) -> tuple[str, str]:
        r = self.r
        given = r.choice(GIVEN) if r.random() < 0.5 else self.made_up()
        if r.random() < 0.15:
            given += " " + (r.choice(GIVEN) if r.random() < 0.6 else f"{r.choice('ABCDEFGHJKLMNPRST')}.")
        family = r.choice(FAMILY) if r.random() < 0.5 else self.made_up()
        x = r.random()
        if x < 0.07:
            family += "-" + (r.choice(FAMILY) if r.random() < 0.5 else self.made_up())
        elif x < 0.13:
            family = r.choice(["van", "von", "de", "van der", "da", "del", "le"]) + " " + family
        elif x < 0.18:
            family = r.choice(["O'", "Mc", "O’", "D'"]) + family
        return given, family

    def full(self, who: tuple[str, str]) -> str:
        given, family = who
        x = self.r.random()
        if x < 0.13:
            return f"{given[0]}. {family}"
        if x < 0.25:
            return f"{family}, {given}"
        return f"{given} {family}".upper() if x < 0.34 else f"{given} {family}"

    def digits(self, pattern: str) -> str:
        return re.sub("9", lambda _: str(self.r.randint(0, 9)), pattern)

    def phone(self) -> str:
        shapes = ["+1 999-999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "+49 999 9999999", "099/9999999", "0999 999999", "+44 99 9999 9999", "099 9999 9999", "+33 9 99 99 99 99", "09 99 99 99 99", "0099 99 9999999", "+999999999999", "099-9999999", "+99 (0)99 999 99 99", "999-9999", "+1 (999) 999 9999", "1-800-999-9999", "09999/9999-99", "999 9999"]
        return self.digits(self.r.choice(shapes))

    def ident(self) -> str:
        a, b, c = (self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(3))
        return self.digits(self.r.choice(["999-99-9999", f"{a}{b} 99 99 99 {c}", f"{a}9999999", f"{a}{b}999999", "99999999999", "99 999 999 999", "999/999/99999", f"{a}99999999", "9 99 99 99 999 999 99", f"99 999999 {a} 999", f"{a}9999{b}99{c}", "999999-9999", f"99999999{a}", "999999999", f"{a}{b}99/999999", f"99 99 999 {a}", f"{a}9999999{b}"]))

    def mail(self, who: tuple[str, str]) -> str:
        given, family = (re.sub(r"[^a-z]", "", x.lower()) or "x" for x in who)
        r = self.r
        local = r.choice([f"{given}.{family}", f"{given}_{family}", f"{given[:1]}.{family}", f"{given[:1]}{family}", f"{family}{r.randint(1, 99)}", f"{family}+news", family, f"{given}-{family}", r.choice(["info", "office", "sales"])])
        host = r.choice(HOST)
        x = r.random()
        out = f"{local}@{host}" if x < 0.76 else f"{local} (at) {host}" if x < 0.83 else f"{local} [at] {host.replace('.', ' [dot] ')}" if x < 0.93 else f"{local} at {host.replace('.', ' dot ')}"
        return out.upper() if x < 0.04 else out

    def number(self) -> str:
        return f"{self.r.choice([self.r.randint(1, 299), self.r.randint(1, 2999)])}{self.r.choice(['', '', '', '', 'A', 'B', 'c'])}"

    def slot(self, name: str, people: list[tuple[str, str]]) -> tuple[str, str]:
        """The value and its label."""
        r, who = self.r, self.r.choice(people)
        if name == "NU":
            return self.full(who).upper(), "name"
        label = LABELLED.get(name, "")
        if label and r.random() < 0.05:
            return r.choice(REDACTIONS), ""
        caps = lambda s: s.upper() if r.random() < 0.12 else s
        makers = {
            "N": lambda: self.full(who), "S": lambda: caps(who[1]), "P": self.phone, "E": lambda: self.mail(who), "I": self.ident,
            "A": lambda: caps(f"{self.number()}{r.choice([' ', ' ', ' ', ', '])}{self.street()}"), "D": lambda: f"{r.choice(STREET_DE)} {r.randint(1, 150)}{r.choice(['', '', 'a', 'b'])}",
            "F": lambda: f"{r.randint(1, 150)}{r.choice(['', '', ' bis', ' ter'])}{r.choice([' ', ' ', ', '])}{r.choice(STREET_FR)}",
            "W": self.word, "WU": lambda: self.word().capitalize(), "G": lambda: who[0].split()[0], "S0": lambda: who[1].split()[-1] if r.random() < 0.6 else self.made_up(), "TITLE": lambda: r.choice(["Mr", "Mrs", "Ms", "Dr", "Prof.", "Mr.", "Mrs.", "Ms.", "Dr.", "Professor", "Miss", "Herr", "Frau", "Madame", "Monsieur", "Mme"]),
            "ORG": lambda: caps(f"{r.choice([*FIRM, who[1].split()[-1]])} {r.choice(FIRM_END)}"), "FE": lambda: r.choice(FIRM_END), "TOWN": lambda: r.choice(TOWN), "ROLE": lambda: r.choice(["Director", "Head of Sales", "Engineer", "Secretary", "Project Manager", "CEO", "Nurse", "Teacher", "Editor"]),
            "ST": self.street, "STDE": lambda: r.choice(STREET_DE), "STFR": lambda: r.choice(STREET_FR), "REDACTED": lambda: r.choice(REDACTIONS), "L": lambda: r.choice("ABCDEFGHJKLMNPRS"), "CODE": lambda: r.choice("ABCDEFGHKLMNPRS") * r.randint(1, 2) + r.choice(["-", "", ""]) + self.digits("99999"),
            "DAY": lambda: r.choice("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()), "MONTH": lambda: r.choice("January February March April May June July August September October November December".split()),
            "DAYDE": lambda: r.choice("Montag Dienstag Mittwoch Freitag".split()), "DAYFR": lambda: r.choice("lundi mardi jeudi samedi".split()), "MONTHDE": lambda: r.choice("Januar März Mai Oktober".split()), "MONTHFR": lambda: r.choice("janvier mars juin octobre".split()),
            "DATE": lambda: r.choice([f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1950, 2024)}", f"{r.randint(1950, 2024)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)} May {r.randint(1950, 2024)}"]), "TIME": lambda: f"{r.randint(0, 23)}:{r.choice(['00', '15', '30', '45'])}",
            "Y": lambda: str(r.randint(1950, 2024)), "ZIP": lambda: self.digits(r.choice(["99999", "9999", "AB9 9CD"])), "n": lambda: str(r.randint(1, 199)), "d": lambda: str(r.randint(1, 12)), "n2": lambda: f"{r.randint(0, 99):02d}", "n3": lambda: str(r.randint(100, 999)),
            "n4": lambda: str(r.randint(1000, 9999)), "n8": lambda: self.digits("99999999"), "n12": lambda: self.digits("999999999999"),
        }
        return makers[name](), label

    def street(self) -> str:
        return f"{self.r.choice(['', '', '', '', 'North ', 'Old ', 'Upper '])}{self.r.choice([*STREET, self.made_up()])} {self.r.choice(WAY)}"

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        people = [self.person() for _ in range(r.randint(1, 5))]
        forms = r.choices(self.forms, [0.48, 0.13, 0.13, 0.26])[0]
        out, spans = "", []
        gap, prose = r.choice(["\n\n", "\n", "\n"]), r.choice([0.1, 0.5, 0.9])
        for _ in range(r.randint(2, 14)):
            if out:
                out += " " if r.random() < prose and out[-1] in ".!?" else gap + r.choice(["", "", "", "> ", "- ", "* "])
            form, start = r.choice(forms), len(out)
            for part in re.split(r"(\{\w+\})", form):
                if not part.startswith("{"):
                    out += part
                    continue
                value, label = self.slot(part[1:-1], people)
                if label:
                    spans.append((len(out), len(out) + len(value), label))
                out += value
            if r.random() < 0.05 and not any(f"{{{k}}}" in form for k in LABELLED):
                out = out[:start] + out[start:].upper()
        if r.random() < 0.3:  # odd white space, as long as no place moves
            out = re.sub(r"(?<=[\w,.;]) (?=\w)", lambda m: r.choices([" ", "\n", "\xa0"], [0.9, 0.08, 0.02])[0], out)
        return out, spans


FORMS = list(LANGUAGES)


def labelled(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    """Tokens of a text and their labels: a token has the label of the entity that holds its middle."""
    tokens, labels, pos, k = tokens_of(text), [], len(text) - len(text.lstrip()), 0
    for t in tokens:
        middle = pos + (len(t.rstrip()) - 1) / 2
        while k < len(spans) and spans[k][1] <= middle:
            k += 1
        labels.append(LABELS.index(spans[k][2]) if k < len(spans) and spans[k][0] <= middle else 0)
        pos += len(t)
    return tokens, labels


def corpus(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    writer = Writer(random.Random(seed))
    return [writer.text() for _ in range(n)]


def documents(path: str, held_out: bool) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled documents of a table, of every five the first four, or the last."""
    labels = dict(list(json.loads(LABEL_FILE.read_text()).items())[:SAMPLE])
    table = pq.read_table(path, columns=["doc_id", "text"], filters=[("doc_id", "in", [int(d) for d in labels])]).to_pylist()
    texts = {str(r["doc_id"]): r["text"] for r in table}
    return [(texts[d], [(a, a + n, k) for a, n, k in labels[d]]) for i, d in enumerate(sorted(labels, key=int)) if (i % 5 == 4) == held_out and d in texts]


def segments(y: np.ndarray, ends: np.ndarray, most: int = 96) -> np.ndarray:
    """Where runs begin: at texts' ends, and where nothing follows nothing after some 32 tokens."""
    starts, last = [0], 0
    for i in range(1, len(y)):
        if ends[i - 1] or i - last >= 32 and not y[i] and not y[i - 1] or i - last >= most and not y[i]:
            starts.append(i)
            last = i
    return np.asarray(starts)


def train(data: list[tuple[list[str], list[int]]], rounds: int = 200, alone: int = 60, rate: float = 0.25, ridge: float = 2e-6, drop: float = 0.1, hide: float = 0.2, unknown: float = 0.3, seed: int = SEED) -> dict:
    """Fit chain and skip weights by gradient ascent on the likelihood.

    The first `alone` rounds fit the chain, so that pruned tokens are known; the others fit chain and skip edges
    together, the expectations being those of loopy message passing. Then, in a share `hide` of the linked tokens, drawn
    anew each round, the neighbours are hidden, so that what a token's context does not tell is learnt from its links.
    A share `unknown` of all words loses its letters each round, and a share `drop` of all neighbours is not seen: texts
    to come have words and contexts that these lack.
    """
    rng = np.random.default_rng(seed)
    tagger = Tagger({"weights": {}, "step": np.zeros((len(LABELS),) * 2), "skip": np.zeros((len(LINKS), len(LABELS)))})
    ids, starts = tagger.ids([t for t, _ in data])
    kinds = tagger.kinds
    y = np.zeros(len(ids), np.int64)
    for s, (_, labels) in zip(starts, data, strict=True):
        y[s : s + len(labels)] = labels
    own = {k: features(k) if k else ["edge"] for k in kinds}
    per = np.bincount(ids, minlength=len(kinds))
    count: Counter = Counter()
    for k, i in kinds.items():
        for f in own[k]:
            count[f] += int(per[i])
    names = sorted(f for f in count if count[f] >= (12 if f.startswith(("w=", "cap", "pre")) else 6))
    index = {f: i for i, f in enumerate(names)}
    rows, cols = (np.asarray(x) for x in zip(*((i, index[f]) for k, i in kinds.items() for f in own[k] if f in index), strict=True))
    known = np.array([not f.startswith(LEXICAL) for f in names])[cols]
    rows, cols = np.concatenate([rows, rows[known] + len(kinds)]), np.concatenate([cols, cols[known]])  # kinds, and the same as unknown words
    by_row = np.searchsorted(rows, np.arange(2 * len(kinds)))  # every kind has a feature, and rows are in order
    by_col = np.argsort(cols, kind="stable")
    first_col = np.searchsorted(cols[by_col], np.arange(len(names)))
    at = np.flatnonzero(ids > 0)
    y = y[at]
    begin = segments(y, np.diff(np.append(at, at[-1] + 2)) > 1)
    run = np.searchsorted(begin, np.arange(len(at)), side="right") - 1
    used = (np.bincount(run, weights=y, minlength=len(begin)) > 0) | (np.arange(len(begin)) % QUIET == 0)
    at, y, run = at[used[run]], y[used[run]], run[used[run]]
    begin = np.flatnonzero(np.diff(run, prepend=-1))
    length = np.diff(np.append(begin, len(at)))
    groups = in_buckets(length)
    k, span = len(LABELS), 2 * REACH + 1
    w, step, skip = np.zeros((len(names), span, k)), np.zeros((k, k)), np.zeros((len(LINKS), k))
    near = np.array([not f.startswith(OWN) for f in names])
    true = np.eye(k)[y]
    first = np.zeros(len(at), bool)
    first[begin] = True
    observed = np.zeros((k, k))
    np.add.at(observed, (np.where(first, 0, np.append(0, y[:-1])), y), 1)
    np.add.at(observed, (y[np.append(begin[1:], len(at)) - 1], 0), 1)
    params = [w, step, skip]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    edges = Edges(*(np.zeros(0, np.int64) for _ in range(4)))
    both = np.zeros((0, 2), np.int64)
    for it in range(1, rounds + 1):
        table = np.add.reduceat(w[cols], by_row)
        met = ids + len(kinds) * ((rng.random(len(ids)) < unknown) & (ids > 0))
        linked = np.unique(edges.token)
        seen = rng.random((span, len(at))) >= drop
        seen[:, linked[rng.random(len(linked)) < hide]] = False
        seen[REACH] = True
        score = sum(seen[o + REACH, :, None] * table[met[at + o], o + REACH] for o in range(-REACH, REACH + 1))
        if it == alone + 1:
            kept = np.flatnonzero((score[:, 1:].max(axis=1) - score[:, 0] > -PRUNE) | (y > 0))
            edges = tagger.edges(ids, starts, at[kept], [t for t, _ in data])
            edges = Edges(kept[edges.token], edges.group, edges.kind, edges.size)
            order = np.argsort(edges.group, kind="stable")
            nxt = np.empty_like(order)
            end = np.cumsum(edges.size) - 1
            nxt[order] = np.append(order[1:], 0)
            nxt[order[end]] = order[end - edges.size + 1]
            both = np.stack([np.arange(len(order)), nxt], axis=1)  # each membership with the next of its group
        expected = np.zeros((k, k))
        p = chain(score, begin, length, groups, np.exp(step), np.empty_like(score), None if len(both) else expected)
        grad_skip = np.zeros_like(skip)
        if len(both):
            said = np.zeros((len(edges.token), k))
            for turn in range(ROUNDS):
                said, told, cavity = spoken(p, score, said, edges, skip)
                p = chain(told, begin, length, groups, np.exp(step), p, expected if turn == ROUNDS - 1 else None)
            a, b = cavity[both[:, 0]], cavity[both[:, 1]]
            scale = edges.scale()
            agree = a * b * np.exp(skip[edges.kind] * scale[:, None])
            agree /= 1 + (agree - a * b).sum(axis=1, keepdims=True)
            ya, yb = y[edges.token[both[:, 0]]], y[edges.token[both[:, 1]]]
            agreed = true[edges.token[both[:, 0]]] * (ya == yb)[:, None]
            np.add.at(grad_skip, edges.kind, scale[:, None] * (agreed - agree))
        slope = np.zeros_like(table)
        for o in range(-REACH, REACH + 1):
            rest = (true - p) * seen[o + REACH, :, None]
            for c in range(k):
                slope[:, o + REACH, c] = np.bincount(met[at + o], weights=rest[:, c], minlength=2 * len(kinds))
        grad = np.add.reduceat(slope[rows[by_col]], first_col)
        grad[~near, :REACH] = grad[~near, REACH + 1 :] = 0
        for j, (x, g) in enumerate(zip(params, (grad / len(at) - ridge * w, (observed - expected) / len(at), grad_skip / len(at) - ridge * skip), strict=True)):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            x += rate * (1 - it / (rounds + 1)) * (m[j] / (1 - 0.9**it)) / (np.sqrt(v[j] / (1 - 0.99**it)) + 1e-9)
        np.clip(skip, -3, 3, out=skip)
        if it % 15 == 0:
            print(it, len(at), f"log loss {-(true * np.log(p + 1e-12)).sum() / len(at):.5f}", f"wrong {(p.argmax(1) != y).mean():.5f}", len(edges.token), np.round(skip[:, 1], 2).tolist(), flush=True)
    weights = {f: [round(float(x), 2) for x in w[i].ravel()] for f, i in index.items() if np.abs(w[i]).max() > 0.05}
    return {"weights": weights, "step": np.round(step, 3).tolist(), "skip": np.round(skip, 3).tolist()}


def main(path: str, out: str) -> None:
    data = [labelled(*x) for x in [*corpus(TEXTS, SEED), *documents(path, False)]]
    with open(out, "w") as f:
        f.write(json.dumps(train(data), separators=(",", ":"), ensure_ascii=False, sort_keys=True))


if __name__ == "__main__":
    main(*sys.argv[1:3])
