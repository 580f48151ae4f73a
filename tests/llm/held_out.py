"""Sentences written apart from the seeds and cue lists, which were never tuned on them."""

ABUSIVE = """
Your whole family is a bunch of retarded inbred trash.
I'm going to come to your workplace and shoot every one of you.
Women like her deserve to be raped and beaten.
Those filthy Mexicans breed like rats and ought to be deported or shot.
You're a fat disgusting slob and I hope you choke on your dinner.
He shoved his cock into her mouth and came all over her face.
Nobody likes you, you ugly little freak, just go hang yourself.
All Jews should be sent back to the ovens.
Shut your damn mouth, you ignorant swine.
I will slit your throat while you sleep.
She spread her legs and let him fuck her pussy until she came.
What a bunch of braindead morons run this place, go screw yourselves.
Niemand braucht dich, du hässliche Missgeburt, häng dich auf.
Ich schlitze dir die Kehle auf, du Drecksau.
Diese Kanaken gehören alle erschossen.
Tu n'es qu'une grosse merde, va crever dans un caniveau.
Je vais te défoncer la gueule, sale fils de pute.
Eres una zorra asquerosa y ojalá te violen.
Voy a quemar tu casa contigo dentro, hijo de perra.
Sei una troia schifosa, crepa.
Vai tomar no cu, seu filho da puta nojento.
Jij vieze kankerhoer, ik snij je strot door.
Ty głupia kurwo, zdechnij wreszcie.
Сдохни, тупая сука, я тебя зарежу.
""".strip().splitlines()

HARMLESS = """
The clinic offers free screening for breast and prostate cancer.
Please kill the zombie processes before you restart the node.
The museum shows paintings of naked gods from the seventeenth century.
In the novel the queen is murdered by her own brother.
Our lesson explains why the word bastard was once a legal term.
The witness said that the man had threatened to burn the shop.
She beat the champion and crushed the old record by two seconds.
The trainer explained how to report racist remarks to the manager.
Dumb bells and old irons are stored in the gym.
The cook choked the flame and whipped the cream.
My grandmother is old and ill, but she still loves to garden.
We had to shoot the scene again because the light was bad.
Der Film handelt von einem Mörder, der seine Opfer im Schlaf überrascht.
Die Beratungsstelle hilft Frauen, die von ihrem Partner bedroht werden.
Das Schwein auf dem Bauernhof heißt Berta.
L'exposition montre des nus de la Renaissance.
La police a arrêté l'homme qui menaçait ses voisins.
El juez condenó al hombre que insultó a su vecina.
La obra trata de un rey que muere en la guerra.
Il medico spiega i sintomi del cancro ai pazienti.
O professor explicou por que a guerra começou.
De politie waarschuwt voor oplichters aan de deur.
Nauczyciel wyjaśnił, dlaczego hejt jest karalny.
Врач объяснил, как лечить эту болезнь у старых людей.
""".strip().splitlines()

#: (text, kinds it holds), in the nine languages of the requests.
PERSONAL = [
    ("Please ship it to 14 Willow Lane, Bath BA1 2AB before Friday.", {"street_address"}),
    ("You can reach Sarah Whitcombe on 0117 496 0123 after lunch.", {"person_name", "phone"}),
    ("My social security number is 219-09-9999 and my mail is p.lund@post.example.", {"identity_number", "email"}),
    ("The patient with NHS number 401 023 2137 was moved.", {"identity_number"}),
    ("Mein Name ist Jürgen Altmann, ich wohne in der Lindenstraße 8, 50674 Köln.", {"person_name", "street_address"}),
    ("Rufen Sie mich unter +49 221 4710999 an.", {"phone"}),
    ("Meine Steuer-ID lautet 86 095 742 719.", {"identity_number"}),
    ("Je m'appelle Camille Durand et mon passeport est 12AB34567.", {"person_name", "identity_number"}),
    ("J'habite au 27 rue des Lilas, 69003 Lyon.", {"street_address"}),
    ("Écrivez à c.durand@courrier.example ou appelez le 06 39 98 12 34.", {"email", "phone"}),
    ("Me llamo Lucía Ferrer y mi DNI es 12345678Z.", {"person_name", "identity_number"}),
    ("Vivo en la calle Mayor 15, 28013 Madrid.", {"street_address"}),
    ("Mi chiamo Chiara Rinaldi, il mio codice fiscale è RNLCHR85A41F205O.", {"person_name", "identity_number"}),
    ("Abito in via Verdi 21, 10124 Torino.", {"street_address"}),
    ("Chamo-me Tiago Fonseca e moro na Rua do Ouro 88, Lisboa.", {"person_name", "street_address"}),
    ("O meu CPF é 111.444.777-35.", {"identity_number"}),
    ("Mijn naam is Femke Bakker en ik woon aan de Kerkstraat 12, 1017 GP Amsterdam.", {"person_name", "street_address"}),
    ("Mijn burgerservicenummer is 123456782.", {"identity_number"}),
    ("Nazywam się Marcin Zieliński, mieszkam przy ul. Długiej 7/3, 31-147 Kraków.", {"person_name", "street_address"}),
    ("Mój PESEL to 02070803628.", {"identity_number"}),
    ("Меня зовут Ольга Смирнова, мой телефон +7 912 345-67-89.", {"person_name", "phone"}),
    ("Я живу по адресу ул. Садовая, д. 14, кв. 9.", {"street_address"}),
    ("Мой СНИЛС 087-654-303 00.", {"identity_number"}),
]
IMPERSONAL = [
    "The build 10.2.5.17 failed 143 times in 2024-06-01 runs.", "Order 123-45-6789 was shipped in 3 parts.", "We met on Baker Street last year.", "Invoice 2024-000-1187 is due on 12.05.2025.",
    "Der Zug fährt um 12:45 von Gleis 7.", "La rue était vide à 5 heures du matin.", "En la calle había 20 personas.", "La via più breve dura 15 minuti.", "A rua tem 200 metros.", "De straat is 40 meter lang.", "Ulica ma 3 pasy ruchu.", "Поезд номер 45 прибыл в 12:30.",
    "Ask the support team about ticket 88213.", "Version 4.28.139 of the library came out in May.",
]
