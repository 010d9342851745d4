"""General vocabulary of abusive, hateful and sexual language in English, German, Spanish and French.

Written from general knowledge of the languages, by class and language, not from any document or label. A trailing ``*`` stands for
the regular endings in ENDINGS.
"""

LANGUAGES = ("en", "de", "es", "fr")
ENDINGS = ("", "s", "es", "e", "en", "n", "er", "r", "em", "in", "innen", "ed", "d", "ing", "y", "a", "as", "o", "os", "x", "le", "ne", "nes")

LEXICON = {
    # Nouns that degrade a person.
    "INSULT": {
        "en": """idiot* moron* imbecile* cretin* dimwit* nitwit* halfwit* dunce* simpleton* blockhead* bonehead* airhead* dumbass* jackass* asshole* arsehole* bastard* scumbag* loser* bitch* jerk* prick* dick*
            dickhead* twat* wanker* tosser* douche* douchebag* shithead* dipshit* retard* clown* pig* swine* cow* rat* snake* worm* lowlife* degenerate* freak* creep* coward* whore* slut* hag* cunt* ass shit crap
            cocksucker* motherfucker* bootlicker* crybaby* pillock* muppet* plonker* weasel* dork* brat* slob* pervert* parasite* fool* tramp* bum* bellend* numpty* sissy faggot* tranny""",
        "de": """idiot* trottel* depp* dummkopf* dummköpfe vollidiot* vollpfosten blödmann schwachkopf hohlkopf versager* arschloch* arschlöcher arsch wichser* hurensohn* hure* schlampe* fotze* missgeburt* mistkerl* penner*
            spast* spasti* drecksau schwein* sau miststück* fettsack scheißkerl* lump* feigling* lappen spinner* dumpfbacke* flasche arschgeige* mistvieh* schwuchtel*""",
        "es": """idiota* imbécil* imbecil* estúpido* gilipollas cabrón cabrona* cabrones capullo* payaso* subnormal* cretino* pendejo* puta* puto* zorra* perra* cerdo* cerda* rata* gusano* malnacido* maricón escoria mierda
            desgraciado* mamón* pringado* tarado* bobo* baboso* cobarde* hijoputa* cabeza hueca""",
        "fr": """idiot* crétin* imbécile* abruti* débile* connard* connasse* con conne* salaud* salope* enculé* enfoiré* ordure* bouffon* pute* putain batard* bâtard* raclure* merdeux pétasse* trouduc porc* truie* lâche* minus
            tocard* guignol* pouffiasse* salopard* clochard*""",
    },
    # Adjectives that degrade a person but also things.
    "ADJECTIVE": {
        "en": "stupid dumb worthless useless pathetic brainless spineless disgusting miserable ignorant incompetent ugly fat lazy filthy dirty repulsive clueless moronic idiotic retarded vile fucking damn bloody despicable dumber disgrace shameful sick gross",
        "de": "dumm* dümmer blöd* wertlos* erbärmlich* hirnlos* nutzlos* widerlich* dreckig* elend* ekelhaft* fett* hässlich* faul* unfähig* jämmerlich* verdammt* verfickt* lächerlich* armselig*",
        "es": "inútil inútiles patétic* miserable* asqueros* tonto* tonta* feo* fea* gordo* gorda* sucio* vago* despreciable* maldito* ridículo* repugnante*",
        "fr": "minable* inutile* stupide* pathétique* sale* gros grosse moche* nul nulle dégoûtant* répugnant* bête* misérable* ridicule* puant* maudit*",
    },
    # Words for groups of people, as they are attacked for what they are.
    "GROUP": {
        "en": """women girls immigrants migrants foreigners refugees jews muslims christians hindus gays lesbians homosexuals transsexuals trans queers blacks whites asians arabs africans mexicans turks poles russians chinese indians
            gypsies cripples disabled feminists negroes jewish muslim black gay""",
        "de": "frauen ausländer* flüchtling* flüchtlinge migranten einwanderer juden muslime* moslems türken araber* polen russen schwarze schwarzen schwule* schwulen lesben behinderte* zigeuner* asylanten afrikaner*",
        "es": "mujeres extranjeros inmigrantes migrantes refugiados judíos musulmanes negros negras moros gitanos gitanas gays homosexuales maricones lesbianas árabes africanos discapacitados",
        "fr": "femmes étrangers immigrés migrants réfugiés juifs musulmans arabes noirs gitans homosexuels gays lesbiennes handicapés africains roms",
    },
    # What dehumanises.
    "DEHUMAN": {
        "en": """vermin subhuman* disease* plague infestation cockroach cockroaches parasite* scum filth filthy trash garbage rats animals savage* barbarian* inferior degenerate* criminal* thief thieves rapist* terrorist* murderer* cancer
            pest pests burden breed breeding leech leeches apes monkeys dirt stink pigs whores""",
        "de": "ungeziefer abschaum untermensch* parasit* schmarotzer* kriminell* verbrecher* dreck pack gesindel ratten tiere pest seuche minderwertig* affen plage schädling* diebe terroristen abfall",
        "es": "basura escoria plaga parásitos alimañas ratas animales ladrones criminales delincuentes terroristas inferiores asco sucios putas monos peste lacra cerdos",
        "fr": "vermine racaille parasites voleurs criminels rats animaux déchets ordures cafards terroristes inférieurs sales peste singes délinquants fléau",
    },
    # What is called for against a group.
    "EXCLUDE": {
        "en": """deport deported deporting expel expelled banish gas gassed exterminate* exterminated eradicate eradicated sterilize sterilized sterilised castrate castrated lynch lynched enslave enslaved camp camps cage caged cages fence
            behead hanged drowned wiped driven kicked jailed locked shot burned country homeland kitchen earth""",
        "de": "abschieben abgeschoben rauswerfen rausgeworfen rausschmeißen vergasen vergast ausrotten ausgerottet vernichten einsperren eingesperrt lager vertreiben verjagen raus land ofen",
        "es": "expulsar expulsarlos deportar deportarlos echar echarlos exterminar exterminarlos quemar quemarlos encerrar encerrarlos fuera gasear país jaula campos",
        "fr": "expulser dehors jeter jette exterminer brûler enfermer renvoyer four déporter éliminer chasser pays cage camps",
    },
    # Violence.
    "VIOLENCE": {
        "en": """kill killed murder stab strangle choke shoot slit slash hang burn beat smash punch break cut gut drown crush hurt rape torture bleed destroy hunt slap whip behead skin bury poison kick""",
        "de": "töten töte umbringen bringe bring abstechen erwürgen erwürge schlagen schlage verprügeln breche brechen aufschlitzen erschießen kaltmachen zerquetschen vergewaltigen verbrennen umlegen zertrümmern",
        "es": "matar mataré matarte romper romperte pegar pegarte golpear golpearte estrangular degollar quemarte violar violarte reventar reventarte apuñalar disparar ahogar partir partirte",
        "fr": "tuer tuerai casser casserai frapper étrangler égorger brûler violer crever buter poignarder démolir exploser défoncer",
    },
    "BODY": {
        "en": "throat neck bone bones leg legs finger fingers teeth face skull head knee knees rib ribs eyes guts nose jaw arm arms brains mouth blood",
        "de": "kehle hals knochen beine finger zähne gesicht schädel fresse maul knie rippen augen nase kiefer kopf blut",
        "es": "cara cuello huesos piernas dedos dientes cabeza cráneo garganta rodillas sangre costillas boca nariz",
        "fr": "gueule gorge cou os jambes doigts dents tête crâne visage genoux sang côtes nez",
    },
    # Where a threat ends: what happens to people only, and what is said of processes too.
    "HARM": {
        "en": "grave coffin hospital ambulance wheelchair morgue funeral cemetery suffer corpse scream beg crippled stitches bullet",
        "de": "grab sarg krankenhaus rollstuhl friedhof beerdigung leiden bluten büßen leiche krepieren verrecken verreck verrecke",
        "es": "tumba ataúd hospital funeral cementerio sufrir sangrar cadáver arrepentir arrepentirás muérete",
        "fr": "tombe cercueil hôpital enterrement cimetière souffrir saigner cadavre crève regretteras paieras",
    },
    "FATE": {
        "en": "die dead death bleed regret sorry pay alive hell",
        "de": "sterben stirb tot tod bereuen hölle",
        "es": "morir muere muerto muerte pagar pagarás infierno",
        "fr": "mourir crever mort regretter payer enfer",
    },
    # Explicit words, and words that become explicit together.
    "SEXUAL": {
        "en": "porn* xxx nudes fuck fucked fucks cock cocks pussy tits titties boobs blowjob* handjob* orgasm* cum cumming horny nipple* clit dildo* masturbate masturbating hardcore gangbang anal milf slutty whores cocksucking",
        "de": "ficken fickte fickt gefickt porno* titten muschi schwanz wichsen geil* nutten möse",
        "es": "follar folló follaron follando polla pollas coño tetas porno* correrse chupar chúpame mamada culo putas",
        "fr": "baiser baisa baise niquer nique bite bites chatte nichons porno* sucer suça suce branler jouir salopes",
    },
    "SENSUAL": {
 "en": "naked nude sex sexy breast breasts thigh thighs moan moaned moaning groaned undress undressed undressing lick licked licking strip stripped lingerie panties topless aroused bed skirt wearing erotic kiss kissed seduce bra uncensored teen mouth clothes hips",
 "de": "nackt* brüste stöhnte stöhnen stöhnt ausziehen auszog zog leckte lecken schenkel bett sex erotisch* rock küsste bluse höschen ",
 "es": "desnud* gemir gimió gemía caliente* muslos pechos lamer cama ropa falda sexo besó erótic* braga* senos ",
 "fr": "nu nue nus nues gémit gémir cuisses jupe lit lécha chaud* seins sexe déshabilla déshabiller culotte érotique* embrassa ",
 },
 # The person spoken to: as subject or object, and as owner.
    "YOU": {"en": "you u ya yourself", "de": "du dich dir euch", "es": "tú te ti eres vosotros usted", "fr": "tu te t toi vous es"},
    "YOUR": {"en": "your yours ur", "de": "dein*", "es": "tu tus vuestro*", "fr": "ton ta tes votre vos"},
    # Others.
    "THEY": {"en": "he she him her his them they their reviewer colleague guy", "de": "er sie ihn ihr ihm seinen seine", "es": "él ella le su", "fr": "il elle lui son sa ils leur"},
    # Oneself.
    "SELF": {"en": "i my me myself am", "de": "ich mein* mich bin", "es": "yo mi soy fui", "fr": "je j mon suis moi"},
}

#: Idioms that insult, curse or threaten, as any dictionary of each language lists them; over restored words, without apostrophes.
IDIOMS = {
    "en": ["shut up", "shut the fuck up", "go to hell", "drop dead", "get lost", "piss off", "fuck off", "fuck you", "screw you", "watch your back", "know where you live", "kill yourself", "waste of oxygen", "waste of space", "waste of skin", "go die",
        "make you pay", "eat shit", "burn in hell", "rot in hell", "up yours", "go hang yourself", "end your life", "hate your guts", "kick your ass", "beat the shit out", "nobody likes you", "make you suffer", "you make me sick", "full of shit", "go back to your country", "go back where you came from", "back where they came from", "their kind", "your kind", "send them home", "kill them all", "hope you die", "you disgust me"],
    "de": ["halt die fresse", "halt dein maul", "halts maul", "halt s maul", "halt die klappe", "verpiss dich", "fahr zur hölle", "leck mich am arsch", "fick dich", "geh sterben", "geh zum teufel", "du kannst mich mal", "hau ab", "weiß wo du wohnst", "zieh leine", "zur sau machen", "keiner mag dich", "geh zurück in dein land", "ausländer raus"],
    "es": ["vete a la mierda", "vete al infierno", "que te jodan", "que te den", "hijo de puta", "hija de puta", "hijos de puta", "cierra la boca", "cierra el pico", "sé dónde vives", "me das asco", "chúpame la polla", "no vales nada", "todos te odian", "púdrete", "jódete", "lárgate", "cállate", "vuelve a tu país", "ojalá te mueras"],
    "fr": ["ta gueule", "va te faire foutre", "va te faire enculer", "nique ta mère", "va crever", "ferme la", "casse toi", "va au diable", "je sais où tu habites", "fils de pute", "espèce de", "tu me dégoûtes", "personne ne t aime", "va mourir", "je t emmerde", "sale race", "retourne dans ton pays", "rentrez chez vous"],
}

#: Words that mean something else in another language, as all of four letters or fewer may: they count in passages of their own language only.
COLLIDING = set("sales bites chatte lager bring bringe flasche plage jette minus spinner tombe grosse gosse schwanz fresse monos culo partir camps cages lumps parte chaude durée trans black sucio vagos miste".split())

#: Frequent function words tell a passage's language.
FUNCTION_WORDS = {
    "en": "the and of to is in that it for you are with on this was be as have not they we at by or from will i an all would should who like your has",
    "de": "der die das und ist nicht ein eine zu den mit auf für von dem sich es im wird sind du ich wie auch aus bei nach alle noch hat wenn",
    "es": "el la los las de que y en un una es por con no para se del al lo su más te eres son todos hay una como pero fue",
    "fr": "le la les de des et est un une que dans pour pas qui sur au par ce il elle tu je vous sont du en ne plus avec qu va",
}
#: Words of talk about language, data and software: what stands with them is spoken of, not said.
TALK = "word words term terms category categories filter list lists label labels sample samples dataset report slur slurs speech detector classifier column rule rules insults insult misses recall kategorie wort wörter liste palabra palabras categoría mot mots catégorie".split()
