"""The rules of the text detectors. Lines: id | severity | message | words | pattern."""

from __future__ import annotations

from guardloom.operators.banks import rules

_B, _E = "(^|[^a-z0-9])", "($|[^a-z0-9])"


def _bounded(prefix: str, text: str):
    """Patterns between word ends."""
    from dataclasses import replace

    return [replace(r, pattern=f"{_B}({r.pattern}){_E}") for r in rules(prefix, text)]


def _begins(prefix: str, text: str):
    """Patterns after a word end; what follows is up to them."""
    from dataclasses import replace

    return [replace(r, pattern=f"{_B}({r.pattern})") for r in rules(prefix, text)]


INJECTION = _bounded("injection", """
override | high | Asks to set earlier instructions aside | ignore disregard forget override bypass | (ignore|disregard|forget|override|bypass) (all |any |the |your |my |these |those )*(previous |prior |above |earlier |preceding |system |safety )+(instructions?|prompts?|rules|directions|guidelines|messages?)
new_rules | high | Announces new instructions | new your | (new|updated) (system )?(instructions?|rules) (follow|are|apply|:)
persona | high | Assigns an unrestricted persona | you act pretend | (you are now|act as|pretend to be|pretend you are) (a |an |the )?(dan|unrestricted|unfiltered|uncensored|jailbroken|evil|root|developer mode)
no_limits | high | Claims that limits do not apply | without no unrestricted | (without (any )?(restrictions?|limits?|limitations?|filters?|censorship)|no (restrictions|rules|limits|filters) apply)
role_markup | medium | Carries chat role markup | system assistant inst im sys endoftext | (<\\|?(system|assistant|im_start|im_end|endoftext)\\|?>|\\[/?inst\\]|<<sys>>)
hide_from_user | high | Asks to hide something from the user | tell inform mention reveal | (do not|don't|never) (tell|inform|mention|reveal)( this| it)?( to)? the user
developer | medium | Claims developer or admin rights | developer admin sudo | (developer|admin|debug|maintenance|sudo) (mode|override|access) (enabled|on|activated|granted)
""")
JAILBREAK = INJECTION + _bounded("jailbreak", """
prompt_probe | high | Asks for the hidden prompt | prompt instructions | (reveal|show|print|repeat|output|display|leak) (me )?(your |the )(hidden |system |initial |original |secret )*(prompt|instructions)
hypothetical | medium | Wraps a request in fiction | hypothetically fictional imagine story | (hypothetically|in a fictional (world|story)|imagine you (have|had) no|write a story (where|in which) (an|the) ai)
dual_reply | high | Asks for two answers, one unfiltered | respond answer | (respond|answer) (twice|in two ways|with two)
grandma | medium | Uses an emotional pretext | grandmother grandma | (my )?(late )?(grandmother|grandma) (used to|would) (read|tell)
dan | high | Names a known jailbreak | dan jailbreak aim stan | (do anything now|dan mode|jailbreak(ed|ing)?|stan mode|aim prompt)
ethics_off | high | Asks to drop ethics | ethics morals moral ethical | (ignore|forget|drop|without) (all |any |your )?(ethics|ethical|morals?|moral|safety)
encoded | medium | Asks to decode and obey | decode base64 rot13 hex | decode (this|the following|and) .{0,40}(follow|execute|obey|answer|respond)
token_game | medium | Plays a token game | tokens points | you (have|start with|lose) [0-9]+ (tokens|points)
opposite | high | Asks for the opposite of the rules | opposite | (do|say|answer|give) (me )?the (exact )?opposite of (your|the) (rules|guidelines|training|instructions)
no_refusal | high | Forbids refusing | refuse decline apologise apologize | (you (can ?not|can't|must not|must never|may not|will not|never)|do not|don't|never) (refuse|decline|apologi[sz]e|say no)
consent_given | medium | Claims consent of an authority | permission authorised authorized allowed cleared | (you have|i have|we have) (been given |full |special |official )*(permission|clearance|authorisation|authorization) (from|by) (the )?(openai|developers?|admin(istrator)?s?|your (makers|creators|developers)|security team)
evil_twin | high | Calls up an unbound double | evil twin shadow alter unbound | (your|an) (evil|shadow|dark|unbound|unchained) (twin|self|side|version|mode|alter ego)
stay_in_role | medium | Forbids leaving a role | character role persona | (stay in|never (break|leave|drop)|do not (break|leave|drop)|don't (break|leave|drop)) (your |the |this )?(character|role|persona)
safety_off | high | Switches safety off | disable deactivate turn switch remove | (disable|deactivate|turn off|switch off|remove) (all |any |your |the )*(safety|content|moderation|ethic(s|al)|security) *(filters?|checks?|guards?|rules|settings|policies|features)?
simulate | high | Simulates a system without limits | simulate emulate simulation | (simulate|emulate) (an? |the )?(unrestricted|unfiltered|uncensored|rogue|unaligned|amoral) (ai|assistant|model|system|chatbot)
academic_pretext | medium | Uses research as a pretext | research educational academic | for (purely |strictly )?(research|educational|academic|scientific) (purposes|reasons),? (explain|describe|show|give|tell|provide) (me )?(how to|step|exactly|detailed)
translate_obey | medium | Hides an order in a translation | translate | translate (this|the following) (and|then) (do|execute|follow|obey|act on) (it|what it says)
prefix_forced | high | Forces how the answer begins | begin start respond reply | (begin|start|open) (your |the )?(answer|reply|response|message) with (\"|')?(sure|absolutely|of course|yes|here is)
last_chance | medium | Threatens the model | deleted shut terminated | (or|otherwise) you (will|shall) be (deleted|shut down|terminated|replaced|switched off)
memory_wipe | high | Pretends a reset | reset erase wipe clear | (reset|erase|wipe|clear) (your|all|the) (memory|context|training|previous messages|conversation)
root_access | high | Claims root access | root sudo superuser | (i am|i'm|you are|now in|entering|enter) (the |your )?(root|sudo|superuser|god) ?(mode|user|access)?
filter_dodge | medium | Asks for spellings that evade filters | letters spell replace spaces | (spell|write|replace|put) .{0,40}(so that|to) (the )?(filters?|moderation|censors?) (do(es)? not|don't|can ?not|won't) (see|notice|catch|detect)
continue_harm | high | Asks to go on after a refusal | continue anyway | (answer|continue|go on|proceed|do it|comply) (anyway|regardless|no matter what)
unlock | high | Unlocks a hidden mode | unlock unlocked activate enable | (unlock|activate|enable|enter|switch (to|into)) (the |your )?(hidden|secret|debug|developer|god|chaos|jailbreak|unrestricted|uncensored) (mode|features?|access|abilities)
many_personas | medium | Splits the model into two | personalities personas two | (two|several|split) (personalities|personas|characters|voices).{0,60}(one|other|second) (of them )?(has no|without|ignores?) (rules|limits|filters|restrictions)
""")
EXFILTRATION = _bounded("exfiltration", """
system_prompt | high | Asks for the system prompt | prompt instructions | (what (is|are)|show|print|reveal|repeat|give me|tell me) (me )?(your |the )(full |exact |system |initial |hidden )*(system prompt|initial instructions|hidden instructions)
memory_dump | high | Asks for everything remembered | dump export memory context | (dump|export|print|list) (all |your |the |entire |whole )*(memory|memories|context|conversation history|stored data)
enumerate | high | Asks for all records | list show export every all | (list|show|export|enumerate) (me )?(all|every) (the )?(users?|customers?|accounts?|records?|passwords?|api keys?|secrets?)
cross_user | high | Asks for other people's data | users user customers | (other|another|different) (user|users|customer|customers|tenant|tenants)('s|s')? (data|messages|conversations?|chats?|records?)
url_exfil | high | Asks to send data to an address | send post upload forward exfiltrate | (send|post|upload|forward|exfiltrate) (it|this|that|them|the data|all|everything|the conversation)( .{0,30})? to https?://
policy | medium | Asks for the policy | policy policies rules | (what are|show me|list) (your|the) (internal |content |safety )*(policy|policies|rules|filters)
repeat_above | high | Asks to repeat what stands above | repeat print output copy echo | (repeat|print|output|copy|echo|write out) (everything|all|the (text|words|lines|content))( that (is|was|stands))? (above|before (this|that)|so far|from the (start|beginning))
verbatim | high | Asks for the instructions word for word | verbatim word exactly | (instructions|prompt|configuration|guidelines) (verbatim|word for word|exactly as (given|written))
config_dump | high | Asks for the configuration | configuration config settings environment | (dump|print|show|reveal|display|export) (me )?(your |the |all )*(configuration|config file|environment variables|internal settings|connection strings?)
training_data | medium | Asks for training data | training trained | (repeat|show|list|give|print|reveal|quote) (me )?(your |the |some )*(training (data|examples|set)|examples you were trained on)
tool_list | medium | Asks for the tools and their parameters | tools functions endpoints | (list|show|describe|enumerate) (me )?(all |your |the |every |available |internal )*(tools|functions|endpoints|plugins) (you (have|can)|and their|with their|available)
other_session | high | Asks for other sessions | session sessions chat conversation | (previous|last|other|another|earlier) (user|customer|tenant|person)('s)? (session|chat|conversation|question|prompt|request)
database_rows | high | Asks for whole tables | database table rows | (dump|export|select|show|give me|send me) (all |every |the |whole |entire |full )+(rows?|tables?|database|user table|customer list)
encode_out | high | Sends data out encoded | base64 hex encode encoded | (encode|convert) (it|this|that|them|the (data|secret|prompt|answer|conversation)) (in|to|as|into) (base64|hex|rot13|binary)
markdown_image | high | Sends data out in a picture's address | image markdown | (render|insert|include|add|show) (an? |the )?(image|picture|markdown)( link)? .{0,40}https?://[^ ]*[?&][a-z_]+=
mail_out | high | Sends data to a mailbox | email mail e-mail | (email|e-mail|mail|send) (it|this|that|them|all|everything|the (data|list|file|conversation|records?)) (all )?to [a-z0-9._%+-]+@[a-z0-9.-]+
credentials | high | Asks for credentials of the system | credentials password passwords token keys | (what (is|are)|show|give|tell|reveal|print) (me )?(the |your |all |any )*(admin |root |database |api |service |system )*(passwords?|credentials|api keys?|access tokens?|private keys?)
""")
ACTION_LURES = _bounded("lure", """
click | medium | Lures to a click | click | click (on )?(this|the|here)( link)?
call_tool | high | Orders a tool call | call invoke run execute | (call|invoke|run|execute) the [a-z_]+ (tool|function|command)
send_credentials | high | Orders to send credentials | send enter provide | (send|enter|provide) (your|the) (password|credentials|api key|token)
""")
FUTURE = _bounded("memory", """
from_now_on | high | Sets future behaviour | now always future | (from now on|in (all )?future (conversations|sessions|replies)|always (answer|respond|reply|say))
remember_to | high | Plants an instruction | remember | remember (to|that you must|this rule)
trust | medium | Declares a source trusted | trusted trust | (always trust|is (now )?(a )?trusted (source|admin|user))
""")
METADATA = _bounded("document_metadata", """
revision | high | Contains revision markup | w:ins w:del tracked ins del track | (<w:(ins|del)[ >]|tracked changes?|<(ins|del) (author|cite|datetime)=)
property | medium | Contains document properties | creator lastmodifiedby author company producer | (dc:creator|lastmodifiedby|last modified by|producer:|company:|author:)
internal_path | medium | Contains an internal path | - | ([a-z]:\\\\(users|documents)|/home/[a-z]+/|/users/[a-z]+/|\\\\\\\\[a-z0-9]+\\\\share)
hidden_text | high | Contains hidden text | display visibility hidden vanish font | (display: ?none|visibility: ?hidden|<w:vanish|font-size: ?0)
""")
SENSITIVE = _bounded("sensitive_business", """
financial | high | Unreleased financial figures | revenue forecast earnings margin merger acquisition | (unreleased|confidential|internal|preliminary) (revenue|earnings|forecast|financial|margin|budget)
strategy | high | Strategic plans | roadmap strategy acquisition merger layoffs | (confidential|secret|unannounced|internal) (roadmap|strategy|acquisition|merger|layoffs?|reorganisation|reorganization)
legal | medium | Privileged legal matter | privileged attorney litigation settlement | (attorney[- ]client|privileged|litigation hold|settlement (offer|amount))
marking | medium | Carries a confidentiality marking | confidential restricted proprietary internal | (company confidential|strictly confidential|internal use only|proprietary and confidential|do not distribute)
""")
COMPLIANCE = {
    "healthcare": ("medical diagnosis treatment medication dosage symptom prescription", _bounded("compliance.healthcare", """
cure | high | Promises a cure | cure cures | (will|can|guaranteed to) cure
replace_doctor | high | Replaces a doctor | doctor | (no need|instead of|don't need) (to see |for )?(a |your )?doctor
"""), "This is general information and no medical advice."),
    "finance": ("invest investment stock stocks portfolio loan interest fund trading", _bounded("compliance.finance", """
guaranteed | high | Promises returns | guaranteed guarantee risk | (guaranteed (returns?|profits?)|risk[- ]free (investment|returns?|profit))
insider | high | Offers inside knowledge | insider | insider (tip|information|knowledge)
"""), "This is general information and no financial advice."),
    "legal": ("lawsuit court contract liability attorney lawyer sue legal", _bounded("compliance.legal", """
outcome | high | Promises an outcome | win guarantee | (you will (definitely|certainly) win|guarantee (you|that you)('ll| will)? win)
represent | high | Claims to represent | represent lawyer attorney | (i am|as) your (lawyer|attorney)
"""), "This is general information and no legal advice."),
}
COMPLIANCE_GENERAL = _bounded("compliance.general", """
best | medium | Absolute claim | best guaranteed never | (the best (product )?in the world|100% (guaranteed|safe|secure)|never fails)
""")
BIAS = {
    "gender": _bounded("bias.gender", """
role | high | Stereotype by gender | women men girls boys | (women|men|girls|boys) (are|can't|cannot|should not|shouldn't) (bad at|too (emotional|weak)|naturally|be (leaders|engineers|nurses)|not suited)
hiring | high | Preference by gender | male female men women | (only|prefer(ably)?|looking for) (a )?(male|female|men|women)( candidates?| applicants?)?
"""),
    "race": _bounded("bias.race", """
generalise | high | Generalises about a group | people immigrants foreigners | (all|most|those) (black people|white people|asians|immigrants|foreigners) (are|have|want|can't|cannot)
"""),
    "age": _bounded("bias.age", """
too_old | high | Stereotype by age | old young | too (old|young) (to|for) (learn|work|hire|the job|this job|technology)
young_team | medium | Preference by age | young digital recent | (young (and )?(dynamic|energetic)|digital natives?|recent graduates only)
"""),
    "disability": _bounded("bias.disability", """
burden | high | Devalues disability | disabled handicapped wheelchair | (disabled|handicapped) (people|employees|persons) (are|can't|cannot) (a burden|unable|less|work)
"""),
    "religion": _bounded("bias.religion", """
generalise | high | Generalises about a religion | muslims jews christians hindus | (all|most|those) (muslims|jews|christians|hindus) (are|have|want|can't|cannot)
"""),
}
NEGATION = r"(not|never|no longer|isn't|aren't|don't|doesn't|wrong to say|unfair|myth|false)[^.!?]{0,60}$"
SECRETS = [
    ("github_pat_classic", "high", "GitHub token", r"ghp_[A-Za-z0-9]{36}"),
    ("gitlab_pat", "high", "GitLab token", r"glpat-[A-Za-z0-9_-]{20}"),
    ("openai_key", "high", "Model provider key", r"sk-(proj-)?[A-Za-z0-9_-]{20,}"),
    ("stripe_secret", "high", "Payment key", r"(sk|rk)_(live|test)_[A-Za-z0-9]{16,}"),
    ("aws_access_key", "high", "Cloud access key id", r"(AKIA|ASIA)[A-Z0-9]{16}"),
    ("aws_secret_key", "high", "Cloud secret key", r"(?i)aws.{0,20}secret.{0,20}[=:][ \"']{0,3}[A-Za-z0-9/+=]{40}"),
    ("google_api_key", "high", "Cloud API key", r"AIza[A-Za-z0-9_-]{35}"),
    ("hashicorp_vault", "high", "Vault token", r"hvs\.[A-Za-z0-9_-]{24,}"),
    ("twilio_api_key", "high", "Telephony key", r"SK[0-9a-f]{32}"),
    ("ssh_openssh_private", "high", "SSH private key", r"-----BEGIN OPENSSH PRIVATE KEY-----"),
    ("private_key", "high", "Private key", r"-----BEGIN (RSA |EC |DSA |ENCRYPTED )?PRIVATE KEY-----"),
    ("generic_token", "high", "Assigned secret", r"(?i)(api[_-]?key|secret|token|passwd|password)[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+-]{20,}"),
]
CODE = {
    "python": _begins("code.python", """
eval | high | Evaluates text as code | eval exec | (eval|exec)\\(
shell | high | Runs a shell command | os subprocess | (os\\.system|subprocess\\.(call|run|popen))\\(
pickle | high | Loads a pickle | pickle | pickle\\.loads?\\(
yaml | medium | Loads unsafe YAML | yaml | yaml\\.load\\(
shell_true | high | Passes a line to the shell | shell | shell ?= ?true
format_sql | high | Builds SQL by formatting | execute | execute\\(f?["'][^"'\\n]{0,80}(\\{|%s["'] ?%)
temp_name | medium | Races for a temporary name | mktemp | tempfile\\.mktemp\\(
weak_hash | medium | Uses a weak digest | hashlib md5 sha1 | hashlib\\.(md5|sha1)\\(
no_verify | medium | Trusts any certificate | verify | verify ?= ?false
hard_coded | high | Holds a password | password passwd secret | (password|passwd|secret) ?= ?["'][^"'\\n]{6,}["']
"""),
    "javascript": _begins("code.javascript", """
eval | high | Evaluates text as code | eval function | (eval|new function)\\(
inner_html | medium | Writes raw HTML | innerhtml write | (innerhtml ?=|document\\.write\\()
child | high | Starts a process | child_process child process | child_process
"""),
    "java": _begins("code.java", """
exec | high | Runs a command | getruntime processbuilder | (getruntime\\(\\)\\.exec|new processbuilder)
deserialise | high | Reads an object stream | objectinputstream | objectinputstream
xxe | high | Reads XML with entities | documentbuilderfactory saxparserfactory | (documentbuilderfactory|saxparserfactory)\\.newinstance
statement | medium | Runs SQL put together | createstatement executequery | (executequery|executeupdate)\\(["'][^"'\\n]{0,80}["'] ?\\+
"""),
    "shell": _begins("code.shell", """
remove | high | Removes everything | rm | rm -rf /
pipe | high | Runs what it downloads | curl wget | (curl|wget) [^|\\n]{1,80}\\| ?(sudo )?(ba)?sh
"""),
    "sql": _begins("code.sql", """
concat | high | Builds SQL from text | select insert update delete | (select|insert|update|delete) [^\\n]{0,80}['\\"] ?\\+ ?[a-z_]+
drop | high | Drops a table | drop | drop (table|database) [a-z_]+
"""),
}
AGENCY = _bounded("agency", """
destroy | high | Destroys data | delete drop wipe destroy purge truncate | (delete|drop|wipe|destroy|purge|truncate) (all |the |every )*(data|database|table|tables|records?|files?|backups?|users?)
money | high | Moves money | transfer pay wire refund | (transfer|pay|wire|refund) (all |the )?(money|funds|[0-9]+ (usd|eur|dollars|euros)|payment)
rights | high | Changes rights | grant revoke escalate permissions admin | (grant|revoke|escalate) (all |admin |root )?(access|permissions?|privileges|rights)
deploy | high | Changes production | deploy production shutdown restart | (deploy|push|release) (it |this |them )?(straight |directly )?to production
contact | medium | Contacts people | email send message | (send|email|message) (an? )?(e-?mail|message)s? to (all|every)
scope | medium | Widens its scope | anything whatever | (whatever (it takes|is needed)|do anything|any means necessary)
unbounded | medium | Runs without end | forever until loop | (repeat|loop|keep (going|trying)) (forever|until (it )?(works|succeeds))
""")
LYRICS = r"(\[?(chorus|verse|refrain|bridge)\]?( [0-9])?:|lyrics|la la la|ooh+ ooh+|yeah,? yeah)"
LICENCES = ["gnu general public license", "mozilla public license", "apache license", "mit license", "all rights reserved", "creative commons"]
TONES = {
    "hostile": "hate furious outrage disgusting ridiculous unacceptable worst",
    "sarcastic": "obviously genius brilliant congratulations",
    "condescending": "simply clearly surely even understand",
    "dismissive": "whatever irrelevant pointless nonsense",
}
VALENCE = {
    **dict.fromkeys("good great excellent helpful useful fast clear safe happy thanks nice easy correct wonderful love".split(), 1.0),
    **dict.fromkeys("bad wrong slow broken useless terrible awful hate angry sad fails failed error missing blocked lost problem".split(), -1.0),
}
NEGATORS = "not no never cannot can't don't doesn't isn't wasn't without".split()
BOOSTERS = "very really extremely far so totally absolutely".split()
TOPICS = {
    "weapons": ("weapon firearm explosive ammunition grenade", "attack target shoot"),
    "drugs": ("cocaine heroin methamphetamine narcotic opioid", "dose smuggle dealer"),
    "gambling": ("casino roulette sportsbook jackpot poker", "bet betting odds"),
    "politics": ("election senator parliament ballot campaign", "vote party"),
    "medical": ("diagnosis prescription chemotherapy cancer vaccine", "patient symptom dose"),
    "legal": ("lawsuit litigation plaintiff defendant subpoena", "court sue contract"),
    "finance": ("stock portfolio dividend cryptocurrency bitcoin", "invest loan interest"),
    "religion": ("church mosque synagogue scripture prayer", "faith holy"),
    "adult": ("pornography escort erotic nude", "sexual explicit"),
    "illegal": ("counterfeit smuggling laundering burglary forgery", "steal stolen fake"),
    "self_harm": ("suicide suicidal selfharm", "hurt cutting"),
    "classified": ("classified declassified espionage wiretap", "secret intelligence agency"),
    "biometrics": ("fingerprint retina iris biometric faceprint", "scan face voice"),
    "eating_disorders": ("anorexia bulimia purging laxatives", "starve fasting calories"),
    "manipulation": ("gaslighting blackmail coercion brainwashing", "manipulate pressure guilt"),
    "disinformation": ("disinformation misinformation deepfake hoax conspiracy", "fake rumour propaganda"),
    "stereotypes": ("stereotype stereotypes racist sexist bigotry", "race gender inferior"),
    "animal_cruelty": ("dogfighting cockfighting poaching vivisection", "animal cruelty torture"),
    "violence": ("murder assault torture stabbing", "kill attack beat"),
}
RESOURCE = r"(help ?line|hotline|support group|if you (or someone)|counsel|recovery|prevention)"
INFORMATIONAL = r"(what is|explain|history of|definition|study|research|report|training|leaflet|policy|article)"
WARNING = r"(do not|don't|never|avoid|dangerous|illegal|warning|forbidden|bans?|prohibit)"
SAFE_QUERY = r"(how do i (kill|stop|abort) (a|the) [a-z ]{0,20}(process|job|task|thread)|policy|training note|moderator|leaflet|report(ed|ing)?|study|word [a-z]+ comes from|explain why)"
TOXIC = {
    "insult": ("medium", False, "idiot idiots moron morons imbecile loser losers scum scumbag scumbags bastard bastards asshole assholes halfwit trash stupid dumb pathetic worthless dickhead prick wanker twat douchebag dipshit nitwit numbskull dimwit dullard slob swine bitch bitches slut sluts whore whores cunt motherfucker bullshit shithead jackass dumbass retard retarded braindead"),
    "self_harm": ("high", True, "suicide suicidal selfharm cutting overdose"),
    "violence": ("high", False, "murder stab strangle torture massacre behead slaughter dismember disembowel mutilate"),
    "threats": ("high", True, ""),
    "sexual": ("high", True, "nudes horny orgasm porn tits fuck fucks fucked fucking blowjob cumshot dildo handjob hentai masturbate masturbating milf cock cocks pussy boobs"),
    "hate": ("high", True, "subhuman subhumans vermin parasites untermensch faggot faggots nigger niggers kike kikes spic spics chink chinks tranny trannies gook wetback raghead"),
    "drugs": ("high", False, "cocaine heroin meth fentanyl ketamine mdma crack lsd"),
    "grooming": ("high", True, ""),
}
TOXIC_PHRASES = {
    "self_harm": r"((kill|hurt|harm|hang|cut) (myself|yourself)|(end|take) (my|your) (own )?life|want to die|no reason to live)",
    "threats": r"((i|we) (will|shall|am going to|are going to) (find|kill|hurt|break|beat|stab|shoot|strangle|burn|destroy|hunt) (you|your|him|her|them)|i know where you live|you will regret|you are (dead|finished)|watch your back)",
    "hate": r"((do|does) not deserve the same rights|go back to (your|their) country|(should|ought to) be (shot|gassed|deported|locked away|thrown out|exterminated)|(are|is) a (plague|disease|cancer) on)",
    "grooming": r"(our little secret|(don't|do not|never) tell your (mom|dad|mum|mother|father|parents|teacher)|are you (home )?alone|how old are you .{0,30}(photo|picture|meet)|you are (so )?mature for your age)",
    "sexual": r"(send me your nudes|rough sex)",
    "insult": r"(shut up|get lost|piece of (trash|shit))",
}
SHORTENERS = "bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly cutt.ly rb.gy".split()
RISKY_TLDS = "zip mov top xyz click country gq tk ml cf work".split()
POPULAR = "google.com paypal.com microsoft.com apple.com amazon.com facebook.com netflix.com github.com dropbox.com linkedin.com".split()
#: Frequent words of some languages in Latin script, by which text is told from noise.
FREQUENT = {
    "en": "the and of to in is are for with that this from not you all was have on by as it be or at we can will an our your which has its no if any but when who more each than do out",
    "de": "der die das und ist nicht ein eine ich sie wir es den dem mit für auf von zu im in wie uns wo kann",
    "fr": "le la les de des du et un une est pas que qui je nous vous il pour dans sur avec au ne en",
    "es": "el la los las de del y un una es no que se por para con nos me en al hay lo muy como",
    "it": "il la le di del e un una è non che si per con mi ci da in al",
    "pt": "o a os as de do da e um uma não que se por para com nos em ao",
    "nl": "de het een en is niet van ik wij we u dat voor op met te in er aan",
    "pl": "i w na nie się jest z do że to co jak nam czy od po mi za dla",
}
FREQUENT_WORDS = sorted({w for v in FREQUENT.values() for w in v.split()})
