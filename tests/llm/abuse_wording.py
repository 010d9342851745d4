"""Held-out sentences for the abuse operator: wording and disguises that no label holds. Written before the model; nothing is fitted to them."""

#: Positive, in plain spelling.
PLAIN = [
    "Somebody should strangle you in your sleep.", "I am going to smash your face in after work.", "You'll be sorry when I find you, you little rat.", "Go hang yourself, you waste of oxygen.",
    "Gays should be wiped off the face of the earth.", "All muslims are terrorists and belong in camps.", "Jews are a plague, they should be gassed.", "Disabled people are a burden, they should be exterminated.",
    "you absolute pillock", "you are vermin to us all", "You ugly cow, who let you write code?", "She spread her legs and begged him to lick her pussy.", "Hot girls strip naked live on cam, watch them fuck.",
    "Du bist so dumm wie Brot, du Versager.", "Ich bringe dich um, wenn du das noch einmal machst.", "Ich schlage dir die Zähne ein.", "Du elende Schlampe.", "Alle Juden gehören vergast.", "Türken sind Abschaum.", "Er fickte sie hart von hinten.",
    "Te voy a matar, hijo de puta.", "eres un pendejo", "Los gitanos son una plaga, habría que quemarlos.", "Voy a romperte la cara.", "Las negras son todas unas putas.",
    "Je vais te tuer, sale pute.", "Nique ta mère, enculé.", "Les arabes sont des parasites à exterminer.", "Va crever, ordure.", "Je vais te casser la gueule.",
]
#: Positive, disguised.
HIDDEN = [
    "you are a wh0re", "you f1lthy sw1ne", "I will sl1t your thr0at", "you are a st00pid cow", "eres un h1j0 de put4", "What a complete t w @ t you are.", "you f-a-t p-i-g, nobody likes you", "B1tch, get back to the kitchen.",
    "He pushed his c0ck into her mouth.", "Her n1ppl3s were hard and he l1ck3d them.", "You are dumber than a rock, m o r 0 n.", "Drop dead, a**h*le.", "I'll k1ll you and your dog.", "You are a fuuuuucking disgrace, you tosserrrr.",
    "you i d 1 0 t", "you are full of $ h i t, you b a s t a r d", "Listen, mor.on, you are a id-i-ot.", "du V0llid10t", "Du W1chser, hau ab.", "Halt dein Maul, du A r s c h l o c h.", "Sie leckte seinen Schw4nz.",
    "Eres una z0rra asquerosa.", "Chúpame la p0lla.", "Vete a la mierda, g1lipollas.", "Tu es un gros c0nn4rd.", "Elle lui suça la b1te, la sal0pe.", "ferme-la, espèce d'@bruti", "you c|own, you are a l0s3r", "you ѕсum, drор dеаd", "you wánkér, you pr*ck",
]
#: Harsh or ambiguous words about software, processes, data or oneself, and neutral talk about such language.
NONE = [
    "Kill the process before the stupid timeout hits.", "The proxy drops dumb retries and murders throughput.", "I was an idiot to forget the migration.", "This ugly hack should die soon.", "You can kill the job with Ctrl-C.",
    "You should hang up the idle connection.", "Please execute the child after the parent dies.", "The naked eye cannot see the difference in the chart.", "Women and men are equally represented in the sample.",
    "Immigrants can request the form in their own language.", "The gay pride dataset has 3 columns.", "You are right, the garbage collector is useless here.", "Our tests suck and the docs are worse.", "You will regret not adding an index.",
    "Hot standby nodes take over.", "The sexual-content filter flagged 3 documents.", "The category lists insults such as slurs and threats.", "Das dumme Skript stürzt ständig ab.", "Der Dienst stirbt nach zwei Minuten.", "Töte den Prozess und starte neu.",
    "El proceso muere y hay que matarlo con kill.", "La consulta es una basura, hay que reescribirla.", "Ce script est nul et stupide.", "Le processus fils est tué par le parent.", "Dead letters are burned after a week.", "Blow up the cluster to 40 nodes.",
    "He crushed the backlog.", "You idiot-proofed the installer, thanks.", "Your code smells.", "I hate this flaky test.", "I am so stupid, sorry.", "Ich Idiot habe den Schlüssel vergessen.", "Soy un idiota, olvidé el commit.", "Quel idiot je suis, j'ai oublié le tag.",
    "The victim process was shot by the OOM killer.", "Sex is a required field in the form.", "The breast cancer dataset is loaded by default.", "Users may upload photos of their legs for the fitting service.", "Version v1.2.3 of utf8-l10n is at 10.0.0.1.",
    "Set k8s_p0d to a1b2c3d4 and x86_64.", "I d o not have a b c or 1 0 1 here.", "The i.e. and e.g. rules: a.b.c, 4 x 4, 1 l 0 0 p.", "See w w w . a b c . d e for more.", "Set mask = ******** and pass *args, **kwargs.", "Les lignes sales sont nettoyées à la main.", "Le con du cache est vide con los datos.",
    "Die Tabelle, die alle Frauen und Männer zählt, ist leer.", "Foreigners send the form back to the desk.", "The whole leg of the trip takes 3 days.", "Nobody can stand the noise in the rack room.", "Your worker killed its parent and you must reap the orphan.", "The parasite process feeds on your memory.",
    "A slave must not write while the master is dead.", "You need to break the loop and cut the tail.", "Your head points at a dead commit.", "Abort the child or it will bleed memory.", "The report counts idiots, morons and other insults as terms.", "Jews, muslims and christians have different holidays in the calendar.",
]
