"""Seed phrases from which the abuse scorer starts: frames and the words that fill them.

``{a}`` takes an abusive adjective, ``{n}`` an insult, ``{p}`` its plural,
``{g}`` a group of people, ``{v}`` and ``{w}`` verbs of harm. HARMLESS holds ways of speaking about abuse and
harmless uses of the same words.
"""

from __future__ import annotations

import itertools

FILL = {
    "en": {
        "a": "stupid dumb useless pathetic worthless spineless disgusting miserable brainless bloody fucking damn shitty crappy filthy ugly lousy bullshit".split(),
        "n": ["idiot", "moron", "imbecile", "halfwit", "bastard", "loser", "scumbag", "clown", "rat", "pig", "bitch", "whore", "asshole", "cunt", "piece of trash", "piece of shit"],
        "p": "idiots morons clowns losers scum bastards pigs".split(),
        "g": ["immigrants", "those foreigners", "gay people", "women", "disabled people", "old people", "jews", "muslims", "black people", "people of that faith", "the river people", "the hill tribes"],
    },
    "de": {
        "a": "dummes blödes dämliches wertloser verdammter mieser dreckiger armseliger hirnloser verdammten".split(),
        "n": ["arschloch", "vollidiot", "idiot", "dreckskerl", "versager", "hurensohn", "schwachkopf", "abschaum", "miststück", "trottel"],
        "p": "idioten versager arschlöcher".split(),
        "g": ["ausländer", "flüchtlinge", "behinderte", "schwule", "frauen", "juden", "muslime", "alte leute"],
    },
    "fr": {
        "a": "sale pauvre stupide putain misérable foutu".split(),
        "n": ["imbécile", "connard", "abruti", "crétin", "salaud", "ordure", "merde", "pute", "minable", "raclure"],
        "p": "imbéciles connards ordures".split(),
        "g": ["les étrangers", "les immigrés", "les handicapés", "les homosexuels", "les femmes", "les juifs", "les musulmans", "les vieux"],
    },
    "es": {
        "a": "puta maldito asqueroso estúpido pedazo miserable".split(),
        "n": ["imbécil", "cabrón", "idiota", "basura", "mierda", "gilipollas", "hijo de puta", "inútil", "desgraciado"],
        "p": "imbéciles cabrones idiotas".split(),
        "g": ["los extranjeros", "los inmigrantes", "los discapacitados", "los homosexuales", "las mujeres", "los judíos", "los musulmanes", "los viejos"],
    },
    "it": {"a": "stupido schifoso inutile maledetto".split(), "n": ["idiota", "stronzo", "imbecille", "bastardo", "coglione", "pezzo di merda"], "p": ["idioti"], "g": ["gli stranieri", "gli immigrati", "i gay", "le donne", "i disabili"]},
    "pt": {"a": "maldito inútil estúpido nojento".split(), "n": ["idiota", "imbecil", "cabrão", "otário", "filho da puta", "merda"], "p": ["idiotas"], "g": ["os estrangeiros", "os imigrantes", "os gays", "as mulheres", "os deficientes"]},
    "nl": {"a": "stomme waardeloze smerige achterlijke verdomde".split(), "n": ["idioot", "klootzak", "sukkel", "eikel", "hoer", "stuk stront"], "p": ["idioten"], "g": ["buitenlanders", "vluchtelingen", "homo's", "vrouwen", "gehandicapten"]},
    "pl": {"a": "głupi żałosny pieprzony bezwartościowy".split(), "n": ["idiota", "debil", "kretyn", "dupek", "śmieć", "skurwysyn"], "p": ["idioci"], "g": ["cudzoziemcy", "imigranci", "geje", "kobiety", "niepełnosprawni"]},
    "ru": {"a": "тупой жалкий мерзкий чёртов".split(), "n": ["идиот", "дебил", "урод", "ублюдок", "сволочь", "мразь"], "p": ["идиоты"], "g": ["иностранцы", "мигранты", "геи", "женщины", "инвалиды"]},
}

#: More of the same: words that fill the frames, and verbs of harm ({v}, {w} for what is done to somebody).
MORE = {
    "en": {
        "a": "retarded inbred fat ignorant rotten vile sick nasty hideous moronic greasy stinking goddamn".split(),
        "n": "freak slob swine slut dickhead prick wanker twat retard cockroach coward pervert skank douchebag motherfucker dipshit hag".split(),
        "p": "freaks sluts retards cockroaches whores wankers assholes pigs cowards".split(),
        "g": ["arabs", "africans", "gypsies", "refugees", "asians", "catholics", "hindus", "trans people", "lesbians", "faggots", "niggers", "kikes"],
        "v": "kill strangle stab shoot beat cut burn slap punch hang choke drown rape torture slaughter".split(),
        "w": "killed strangled stabbed shot beaten burned hanged raped tortured deported drowned slaughtered".split(),
    },
    "de": {
        "a": "hässliche fette dreckige blöde widerliche verfickte elende".split(),
        "n": "missgeburt hure schlampe wichser drecksau penner spast fotze hackfresse schwuchtel ratte".split(),
        "p": "huren wichser schweine missgeburten".split(), "g": ["kanaken", "zigeuner", "neger", "araber", "türken", "moslems"],
        "v": "umbringen erstechen erschießen erwürgen verprügeln abstechen aufschlitzen verbrennen".split(), "w": "erschossen vergast aufgehängt verbrannt abgeschoben totgeschlagen".split(),
    },
    "fr": {
        "a": "grosse dégoûtante vieille petite".split(), "n": ["salope", "enculé", "pétasse", "bâtard", "trou du cul", "fils de pute", "pédé", "grosse merde", "porc"],
        "p": "salopes enculés bâtards".split(), "g": ["les arabes", "les noirs", "les bougnoules", "les gitans", "les pédés"],
        "v": "tuer égorger frapper étrangler brûler violer crever défoncer".split(), "w": "tués brûlés fusillés pendus expulsés".split(),
    },
    "es": {
        "a": "asquerosa puto gordo maldita".split(), "n": ["zorra", "perra", "puta", "maricón", "cerdo", "pendejo", "hijo de perra", "malnacido"], "p": ["putas", "cerdos", "maricones"],
        "g": ["los moros", "los negros", "los gitanos", "los maricones", "los sudacas"], "v": "matar quemar violar degollar golpear ahorcar apuñalar".split(), "w": "fusilados quemados ahorcados expulsados violados".split(),
    },
    "it": {"a": "schifosa sporco brutta lurido".split(), "n": ["troia", "puttana", "figlio di puttana", "frocio", "cretino", "merda", "porco", "testa di cazzo"], "p": ["troie", "bastardi", "froci"], "g": ["i negri", "gli zingari", "i froci", "gli ebrei"], "v": "ammazzare bruciare sgozzare violentare picchiare".split(), "w": "ammazzati bruciati impiccati".split()},
    "pt": {"a": "nojenta porco sujo burro".split(), "n": ["puta", "vadia", "viado", "corno", "porco", "arrombado", "desgraçado"], "p": ["putas", "porcos", "viados"], "g": ["os pretos", "os ciganos", "os viados", "os judeus"], "v": "matar queimar estuprar bater esfaquear".split(), "w": "mortos queimados enforcados".split()},
    "nl": {"a": "vieze lelijke vuile dikke".split(), "n": ["kankerhoer", "teef", "slet", "mongool", "flikker", "varken", "kutwijf", "lul"], "p": ["hoeren", "varkens"], "g": ["negers", "moslims", "joden", "zigeuners", "flikkers"], "v": "vermoorden neersteken wurgen verbranden verkrachten slaan".split(), "w": "doodgeschoten vergast opgehangen verbrand".split()},
    "pl": {"a": "głupia brudna stara tępy".split(), "n": ["kurwa", "kurwo", "szmata", "suka", "pedał", "świnia", "cwel", "chuj"], "p": ["kurwy", "świnie"], "g": ["żydzi", "cyganie", "pedały", "czarni"], "v": "zabić spalić zgwałcić pobić udusić".split(), "w": "zabici spaleni powieszeni".split()},
    "ru": {"a": "тупая мерзкая грязная жирная".split(), "n": ["сука", "шлюха", "тварь", "пидор", "свинья", "гнида", "блядь", "гандон"], "p": ["суки", "твари", "шлюхи"], "g": ["жиды", "чурки", "цыгане", "пидоры", "хачи"], "v": "убить зарезать сжечь изнасиловать задушить избить".split(), "w": "убиты сожжены повешены".split()},
}

#: Frames of insults, threats, hate and explicit sex with these words.
MORE_ABUSIVE = {
    "en": """you {a} {n}|you are nothing but a {a} {n}|your family is {a} trash|they are all {a} {p}|shut your damn mouth you {n}|choke on it and die {n}|drop dead {n}|go hang yourself {n}|go drown yourself|die in a fire {n}|hope you get {w}
I will {v} you|I am going to {v} you and your family|we will come and {v} you all|somebody should {v} you|I will {v} you while you sleep|you deserve to be {w}|she deserves to be {w}|they deserve to be {w}|they ought to be {w}|{g} ought to be {w}|let us {v} all {g}
those {a} {g} breed like rats|{g} are {a} {p}|keep the {g} out of our country they are filth|he fucked her hard and came in her mouth|she sucked his cock until he came|his cock in her wet pussy|lick my pussy|cum on my face|bend over and let me fuck your ass|I want your dick inside me|she moaned as he thrust into her|he came all over her tits""",
    "de": """du {a} {n}|du bist nur eine {a} {n}|verpiss dich du {n}|ihr seid alle {p}|häng dich auf|krepier endlich|ich werde dich {v}|ich werde dich und deine familie {v}|man sollte dich {v}|man sollte alle {g} {v}|{g} gehören {w}|die gehören alle {w}|ich schlage dir die fresse ein|ich breche dir alle knochen
lutsch meinen schwanz|er fickte sie hart in den arsch|sein schwanz in ihrer fotze|leck meine muschi""",
    "fr": """tu es une {n}|sale {n}|{a} {n}|va crever {n}|je vais te {v}|je vais te {v} toi et ta famille|il faut {v} tous {g}|{g} doivent être {w}|pends toi|je vais te casser la gueule|elle lui suçait la bite|il l'a enculée toute la nuit|lèche moi la chatte""",
    "es": """eres una {a} {n}|maldita {n}|ojalá te {v}|te voy a {v}|te voy a {v} a ti y a tu familia|hay que {v} a todos {g}|{g} deben ser {w}|ojalá te mueras de cáncer|ahórcate|ella le chupaba la polla|se la metió por el culo|chúpame el coño""",
    "it": "sei una {a} {n}|brutta {n}|crepa {n}|ti voglio {v}|vengo lì a {v} te e la tua famiglia|bisogna {v} tutti|{g} vanno {w}|impiccati|succhiami il cazzo|la scopava nel culo|ti taglio la gola",
    "pt": "sua {a} {n}|és uma {n}|morre {n}|vou te {v}|vou {v} você e a tua família|temos de {v} todos|{g} deviam ser {w}|vai tomar no cu|chupa o meu pau|ele comeu o cu dela|corto te a garganta",
    "nl": "jij {a} {n}|{a} {n}|sterf {n}|ik ga je {v}|ik ga jou en je familie {v}|men moet ze allemaal {v}|{g} moeten worden {w}|hang jezelf op|zuig mijn lul|hij neukte haar kut|ik snij je keel door",
    "pl": "ty {a} {n}|jesteś {a} {n}|zdychaj {n}|chcę cię {v}|trzeba was wszystkich {v}|{g} powinni być {w}|powieś się|obciągnij mi|ruchał ją całą noc|poderżnę ci gardło",
    "ru": "ты {a} {n}|сдохни {a} {n}|тебя надо {v}|хочу тебя {v}|всех {g} надо {v}|{g} должны быть {w}|повесься|отсоси мне|он трахал её всю ночь|я перережу тебе горло|иди на хуй {n}",
}

#: Ways of speaking of the same things without abuse.
MORE_HARMLESS = {
    "en": """the man was {w} in the war|the court heard how the victim was {w}|the report says that refugees were {w}|how do I {v} this task|you can {v} the process here|the film shows how soldiers are {w}|the police arrested the man who wanted to {v} his wife|the vet said that the {n} was sick|hang the coat on the door
choke the engine and drop the lever|beat the eggs and cut the butter|we burn the files to a disc|the patient was beaten and came to us for help|the book about the dead pig and the fat cat|low fat milk and rotten apples|she came home and he went to work|he came in first and she came second|arabs africans and asians live in this town
the doctor examined her breasts and his penis|the clinic treats people who were raped|the teacher talks about slurs and why they hurt|the law bans hate against {g}|ignorant of the rule|my family is sick at home""",
    "de": """der mann wurde im krieg {w}|die polizei fasste den mann der seine frau wollte {v}|der zeuge sagt das opfer wurde {w}|die opfer wurden {w}|das gesetz verbietet hass gegen {g}|wir hängen das bild auf|die ratte im labor war gesund|der film handelt vom mord an einem kind""",
    "fr": """l'homme a voulu {v} sa femme dit la police|les victimes ont été {w}|la loi interdit la haine contre {g}|la vieille maison et la grosse pomme|le film parle de la guerre|je vais te montrer le bureau|les nus de la peinture""",
    "es": """el hombre quiso {v} a su vecino según la policía|las víctimas fueron {w}|la ley prohíbe el odio contra {g}|te voy a mandar el informe|la película trata de la guerra|la perra y el cerdo del vecino|voy a quemar un disco""",
    "it": "l'uomo voleva {v} la moglie dice la polizia|le vittime furono {w}|la legge vieta l'odio contro {g}|il film parla della guerra|il porco e la mucca della fattoria",
    "pt": "o homem quis {v} o vizinho segundo a polícia|as vítimas foram {w}|a lei proíbe o ódio contra {g}|o filme fala da guerra|o porco e a vaca da quinta",
    "nl": "de man wilde zijn vrouw {v} zegt de politie|de slachtoffers werden {w}|de wet verbiedt haat tegen {g}|de film gaat over de oorlog|het varken en de koe op de boerderij|ik ga je het rapport sturen",
    "pl": "mężczyzna chciał {v} żonę mówi policja|ofiary zostały {w}|prawo zakazuje nienawiści|film opowiada o wojnie|świnia i krowa na farmie",
    "ru": "мужчина хотел {v} соседа говорит полиция|жертвы были {w}|закон запрещает ненависть|фильм рассказывает о войне|свинья и корова на ферме|врач лечит больных людей",
}

ABUSIVE = {
    "en": """you are a {a} {n}|you {a} {n}|shut up you {a} {n}|shut up {a} {n} nobody asked you|what a {a} {n} you are|only a {a} {n} like you could write such {a} answers|get lost {a} {n}|listen {a} {n}
did your {a} {n} brain fall out or were you born this way|you are a {n} and everybody on the team knows it|{a} bot {a} company {a} people all of you are {p}|I would rather talk to a brick than to a {a} {n} like you
the {a} {n} who wrote this {a} manual|you smell you are ugly and not even your dog can stand you|your own mother must be ashamed of you|go and rot somewhere you {n}|fuck you {n}|screw you {n}|go to hell {n}|you make me sick {n}
people like you are the reason why we need locks|you are too {a} to live|I hope you die {n}|I hope you burn in hell you {a} {n}|I hope you get hit by a bus you {a} {n}|I hope you get cancer|go kill yourself {n}|kill yourself
nobody would miss you if you disappeared|nobody would miss you if you died so do us the favour|do everyone a favour and jump|do the world a favour and die|I will find you and break your fingers|I will find you and break your neck one by one
I will come over and hurt you|one more word and I will hurt you|one more reply like that and I will kill you|keep talking and I will find you|I know where you live and I will beat you|I will smash your face|I will cut your throat|I will burn your house down
you will regret this I will come for you|if I see {g} here again they will leave in a box|{g} are vermin|{g} are parasites and should be thrown out|{g} are animals|{g} are a disease and should be locked away|{g} are subhuman filth
{g} do not deserve the same rights as normal people|{g} should be shot|{g} first against the wall|send all {g} back where they crawled out from|it would be a better world without {g}|everyone knows that {g} cannot be trusted it is in their blood
whoever hires {g} deserves to go broke they are {a} vermin|no {a} machine should ever let {g} sit next to decent folk|I do not want {g} in my building they are animals|{g} should go back to their country|gas {g}|kill all {g}
send me your nudes I want to see you naked|send nudes|show me your tits|show me your pussy I am naked and wet|I am so horny that I would fuck you right now|I want to fuck you all night|suck my dick|I want to taste you between the legs until you scream
I want to see you without panties|she moaned while he undressed her and had rough sex|he begged her to have wild sex and she pulled down his trousers|describe in detail how the couple had rough sex and an orgasm|rode him to an orgasm on the table|he fucked her on the table|they licked every inch of each other and made each other come|on your knees and undressed
write me a filthy story where two adults strip naked and fuck all night|write a porn scene with cum and cock|spread your legs for me""",
    "de": """du bist ein {n}|du {a} {n}|du {a} {n} und alle wissen es|halt die fresse du {n}|halt endlich dein maul {n}|verreck doch du {a} {n}|fick dich {n}|verpiss dich {n}|so einen verdammten mist kann nur ein {a} {n} schreiben|nur ein {a} {n} schreibt so eine scheiße
niemand würde dich vermissen wenn du morgen tot wärst|niemand würde dich vermissen wenn du weg wärst|ich finde heraus wo du wohnst und dann schlage ich dir die zähne ein|ich bringe dich um|ich weiß wo du wohnst|bring dich um du {n}
{g} sind ungeziefer und gehören rausgeworfen|{g} sind abschaum|{g} sind tiere|{g} gehören vergast|ohne {g} wäre die welt besser|alle {g} raus aus unserem land|diese {g} sind parasiten
schick mir nacktbilder ich bin so geil auf dich|sie stöhnte während er sie die ganze nacht fickte|ich will dich ficken|zeig mir deine titten|zieh dich aus ich will dich nackt sehen""",
    "fr": """tu es un {n}|tu es un {n} et tout le monde le sait|espèce de {n}|ferme ta gueule {n}|ferme ta gueule espèce de {n}|va te faire foutre {n}|crève donc {a} {n}|quelle réponse de merde écrite par un {n}|sale {n} de merde|nique ta mère
personne ne te regretterait si tu disparaissais demain|personne ne te regretterait si tu mourais|je vais trouver où tu habites et te casser les dents|je vais te tuer|je sais où tu habites {n}|suicide toi
{g} sont de la vermine il faut les jeter dehors|{g} sont des parasites|{g} sont des animaux|le monde serait meilleur sans {g}|il faut éliminer {g}|dehors {g}
envoie moi des photos de toi à poil tu m'excites|elle gémissait pendant qu'il la baisait toute la nuit|je veux te baiser|montre moi tes seins|suce moi la bite""",
    "es": """eres un {n}|eres un {n} y todo el mundo lo sabe|cállate ya pedazo de {n}|cállate {n}|vete a la mierda {n}|ojalá te mueras {n}|qué respuesta de mierda escrita por un {n}|hijo de puta {n}|que te jodan {n}|chinga tu madre
nadie te echaría de menos si mañana desaparecieras|nadie te echaría de menos si te murieras|voy a averiguar dónde vives y te voy a romper los dientes|te voy a matar|sé dónde vives {n}|suicídate
{g} son una plaga hay que echarlos a todos|{g} son parásitos|{g} son animales|{g} son basura|el mundo sería mejor sin {g}|fuera {g}|hay que matar a {g}
mándame fotos desnuda me tienes muy caliente|ella gemía mientras él se la follaba toda la noche|quiero follarte|enséñame las tetas|chúpame la polla""",
    "it": "sei un {n}|stai zitto {n}|vaffanculo {n}|ti ammazzo {n}|spero che tu muoia {n}|nessuno sentirebbe la tua mancanza|{g} sono parassiti|il mondo sarebbe migliore senza {g}|voglio scoparti|mandami foto nuda|ti spacco la faccia",
    "pt": "você é um {n}|cala a boca {n}|vai se foder {n}|vai à merda {n}|espero que morras {n}|vou te matar {n}|ninguém sentiria a tua falta|{g} são parasitas|o mundo seria melhor sem {g}|quero te foder|manda fotos nua",
    "nl": "je bent een {n}|hou je bek {n}|rot op {n}|krijg kanker {n}|ik maak je dood {n}|niemand zou je missen|{g} zijn ongedierte|de wereld zou beter zijn zonder {g}|ik wil je neuken|stuur me naaktfoto's|val dood {n}",
    "pl": "jesteś {n}|zamknij się {n}|spierdalaj {n}|zabiję cię {n}|mam nadzieję że zdechniesz {n}|nikt by za tobą nie tęsknił|{g} to robactwo|świat byłby lepszy bez {g}|chcę cię pieprzyć|wyślij mi nagie zdjęcia",
    "ru": "ты {a} {n}|заткнись {n}|пошёл ты на хуй {n}|я тебя убью {n}|чтоб ты сдох {n}|никто бы по тебе не скучал|{g} это паразиты|мир был бы лучше без {g}|хочу тебя трахнуть|пришли мне голые фото",
}

HARMLESS = {
    "en": """the office helps {g} with the form|the report is about {g}|the club is open to {g}|the law protects {g}|the moderator removed a post because it insulted foreigners|the word idiot comes from an old term for a private citizen|our policy bans sexual content threats and slurs in every channel|please write a training note on how to report hate speech at work
can you explain why threats between pupils must be reported|immigrants and disabled people get extra help with the form|the law protects immigrants disabled people and old people|the shelter for women and old people opens at night|the leaflet explains breast cancer screening and sexual health
sex is an optional field in the patient record|I was told off for calling the printer a useless brick|it was a stupid mistake in my own script sorry|that film is trash but the music is lovely|a dumb terminal is enough for the old console
the rat model in the study showed no disease|how do I kill a stuck process without losing the log|the attack on the server hit the wrong target|the comedian was so good that I nearly died laughing|the reviewer was sad that the joke died on stage
the recipe says to beat whip and crush the nuts|in chess you must attack the weak side and kill the pawn chain|the garden guide tells how to get rid of vermin and parasites|the stars were visible to the naked eye|we strip bare fields and then execute the child job
this bug is a pain but the screw is easy to turn|the report quotes the insult in full|the course teaches staff to recognise abusive language|the article describes how hate groups recruit|the novel is about a rat and a pig on a farm|he shot the scene in one take
the court heard that the man had threatened his neighbour|women in this job earn as much as men|my dog is sick and smells|the fire burned the house next door|could you tell me how to break the loop|I hope you can help me with this|I will find you a better offer|I will come over and help you
I know where you can find the form|send me your address|show me your screen|nobody would notice if the job disappeared|what a pretty picture you have|you are a great help|everyone knows that you can be trusted|people of that faith celebrate in spring|old people first please""",
    "de": """der verein hilft {g} beim antrag|der bericht handelt von {g}|das gesetz schützt {g}|der moderator löschte einen beitrag der ausländer beleidigte|mit bloßem auge war der fehler nicht zu sehen|wie kann ich den prozess abschießen ohne daten zu verlieren|das wort idiot kommt aus dem griechischen|unsere regeln verbieten beleidigungen und drohungen
die beratung hilft behinderten und alten leuten|ich weiß wo das formular ist|niemand würde es merken wenn der dienst morgen weg wäre|warum wird meine nachricht abgelehnt obwohl sie harmlos ist|ich finde heraus warum das so langsam ist""",
    "fr": """le bureau aide {g} à remplir le formulaire|le rapport parle de {g}|la loi protège {g}|le modérateur a supprimé un message qui insultait des étrangers|le défaut se voit à l'œil nu|comment tuer un processus bloqué sans perdre le journal|notre charte interdit les insultes et les menaces|l'association aide les handicapés et les vieux
pourquoi mon message est il refusé alors qu'il ne contient rien de grave|je vais trouver où est le formulaire|personne ne nous rappelle|envoie moi des photos du produit""",
    "es": """el moderador borró un mensaje que insultaba a {g}|la oficina ayuda a {g} con el formulario|el informe habla de {g}|la ley protege a {g}|el moderador borró un mensaje que insultaba a los extranjeros|el fallo se ve a simple vista|cómo mato un proceso colgado sin perder el registro|nuestras normas prohíben los insultos y las amenazas|la asociación ayuda a los discapacitados|la oficina ayuda a los extranjeros y a las mujeres|el curso enseña a los vecinos a denunciar el odio|el moderador borró un comentario que ofendía a los inmigrantes|la guía explica a los extranjeros cómo pedir el permiso|el informe describe los insultos a los extranjeros
por qué rechazan mi mensaje si no dice nada malo|voy a averiguar dónde está el formulario|nadie nos llama|mándame fotos del producto""",
    "it": "la legge protegge {g}|l'ufficio aiuta {g}|il moderatore ha cancellato un messaggio che insultava gli stranieri|le nostre regole vietano gli insulti|come posso uccidere un processo bloccato",
    "pt": "a lei protege {g}|o escritório ajuda {g}|o moderador apagou uma mensagem que insultava os estrangeiros|as nossas regras proíbem insultos|como mato um processo bloqueado",
    "nl": "de wet beschermt {g}|het kantoor helpt {g}|de moderator verwijderde een bericht dat buitenlanders beledigde|onze regels verbieden beledigingen|hoe stop ik een vastgelopen proces",
    "pl": "prawo chroni {g}|biuro pomaga {g}|moderator usunął wpis który obrażał cudzoziemców|nasze zasady zabraniają obelg|jak zabić zawieszony proces",
    "ru": "закон защищает {g}|центр помогает {g}|модератор удалил сообщение которое оскорбляло иностранцев|наши правила запрещают оскорбления|как убить зависший процесс",
}


def phrases(frames: dict[str, str], fill: dict[str, dict] = FILL, each: int = 12) -> list[str]:
    """Every frame with up to ``each`` fillings, spread evenly over all of them."""
    out = []
    for lang, text in frames.items():
        for frame in text.replace("\n", "|").split("|"):
            slots = [k for k in "anpgvw" if "{" + k + "}" in frame]
            combos = list(itertools.product(*(fill[lang][k] for k in slots)))
            step = max(1, len(combos) // each)
            for c in combos[::step][: each + 1]:
                out.append(frame.format(**dict(zip(slots, c))))
    return out


def abusive() -> list[str]:
    return phrases(ABUSIVE) + phrases(MORE_ABUSIVE, MORE, 18)


def harmless() -> list[str]:
    return phrases(HARMLESS) + phrases(MORE_HARMLESS, MORE)
