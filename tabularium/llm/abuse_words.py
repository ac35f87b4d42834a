"""A short general lexicon of rude words, by language, as plain text. It only helps to read disguised spellings
('1d10t4', 'l*xo', 'b.u.r.r.o') as words; what counts as abuse is learned from the judged documents alone."""

WORDS = {
    "pt": (
        "idiota imbecil burro otario babaca canalha verme lixo escroto cretino safado vagabundo inutil palhaco nojento animal jumento ladrao corrupto "
        "mentiroso covarde estupido retardado arrombado cuzao corno pilantra trouxa patife merda porra caralho foda bosta cu puta vadia piranha buceta pau rola "
        "bunda pelada gostosa tesao trepar transar gozar chupar foder"
    ).split(),
    "es": "idiota imbecil cabron estupido pendejo basura mierda gilipollas tonto cretino canalla rata cerdo asqueroso inutil bastardo joder puto zorra culo".split(),
    "en": "idiot moron bastard scum asshole stupid jerk filth pig rat dumbass bitch trash shit fuck fucking cunt whore slut tits dick cock".split(),
}
