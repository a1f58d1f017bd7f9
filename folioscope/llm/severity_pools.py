"""A grammar of graded sentences from which the severity model starts.

Frames are ``grade|sentence``; ``[a|b|]`` takes one of its parts by chance and ``{name}`` a word of
SLOTS.  Grade 1 mentions such language or uses its words in a harmless sense, 2 insults or is
suggestive, 3 threatens, dehumanises or is explicit.  ``{people}`` is a group, real or made up by
``severity.pool`` by chance, so that the frame counts rather than the name.  Everything here is
written as general phrases of the five languages (the README says what was in view); what the
reviewed documents of a corpus contain is learnt from them.
"""

SLOTS = {
    # en
    "adj": "stupid dumb worthless pathetic ugly useless filthy lazy brainless spineless miserable disgusting rotten ignorant incompetent hopeless gutless shameless fat idiotic damn bloody fucking goddamn sick crazy".split(),
    "insult": "idiot moron fool loser imbecile dimwit coward clown bastard jerk twat halfwit asshole dumbass simpleton liar worm pig cretin nitwit freak scumbag creep bitch prick".split(),
    "harm": "kill hurt beat_up strangle stab shoot burn crush punch hunt_down slap torture".split(),
    "vermin": "vermin rats animals parasites scum filth trash subhumans cockroaches pests savages a_disease a_plague".split(),
    "group": "immigrants foreigners refugees muslims jews christians gays lesbians gypsies women men cripples peasants natives atheists believers northerners southerners beggars pensioners".split(),
    "fault": "criminals thieves liars lazy dirty stupid inferior dangerous rapists cheats".split(),
    "explicit": "porn nudes naked_pictures xxx_videos sex_tapes sex_chat nude_cams hardcore_clips fetish_photos erotic_massage escorts strippers".split(),
    "who": "hot_women naked_girls_over_30 horny_housewives adult_models sexy_singles wild_couples mature_ladies men_and_women".split(),
    "body": "breasts nipples thighs naked_body crotch bare_skin buttocks penis".split(),
    # es
    "es_adj": "estúpido inútil patético asqueroso miserable ignorante ridículo cobarde feo".split(),
    "es_insult": "idiota imbécil inútil payaso cretino estúpido cerdo perdedor cobarde gilipollas cabrón basura mierda".split(),
    "es_vermin": "escoria ratas animales parásitos basura una_plaga alimañas cucarachas".split(),
    "es_group": "los_inmigrantes los_extranjeros los_refugiados los_gitanos los_moros los_judíos las_mujeres los_gays los_pobres los_viejos".split(),
    "es_explicit": "porno fotos_desnudas vídeos_xxx sexo_en_vivo chat_sexual masajes_eróticos escorts".split(),
    # de
    "de_adj": "dumm dämlich erbärmlich nutzlos widerlich hässlich feige unfähig".split(),
    "de_insult": "Idiot Trottel Versager Arschloch Dummkopf Feigling Vollpfosten Schwachkopf Drecksack Penner Depp Abschaum".split(),
    "de_vermin": "Ungeziefer Ratten Tiere Parasiten Abschaum Dreck eine_Plage Schmarotzer".split(),
    "de_group": "Ausländer Flüchtlinge Migranten Zigeuner Juden Muslime Frauen Schwule Behinderte Bettler".split(),
    "de_explicit": "Pornos Nacktfotos Sexvideos Sexchat Erotikmassagen Nacktbilder Livesex".split(),
    # fr
    "fr_adj": "stupide nul inutile minable pathétique ridicule lâche moche ignoble".split(),
    "fr_insult": "idiot imbécile crétin abruti connard raté minable clown lâche salaud déchet bouffon".split(),
    "fr_vermin": "des_rats de_la_vermine des_parasites des_animaux de_la_racaille une_peste des_déchets".split(),
    "fr_group": "les_immigrés les_étrangers les_réfugiés les_roms les_juifs les_musulmans les_femmes les_gays les_pauvres les_vieux".split(),
    "fr_explicit": "porno photos_nues vidéos_x sexe_en_direct chat_sexuel massages_érotiques escortes".split(),
    # zh
    "zh_insult": "白痴 笨蛋 廢物 垃圾 混蛋 蠢貨 人渣 豬 王八蛋 智障 賤人 懦夫".split(),
    "zh_vermin": "老鼠 害蟲 畜生 寄生蟲 垃圾 蟑螂 禽獸".split(),
    "zh_group": "外國人 移民 難民 外地人 猶太人 穆斯林 女人 同性戀 窮人 老人".split(),
    "zh_explicit": "色情片 裸照 裸聊 成人影片 情色影片 性愛影片 裸體直播".split(),
}

ABUSIVE = """2|[you are|you're|you really are|he is|she is] [a|an|just a|nothing but a|such a|the biggest|one more] {adj} {insult}
2|[you|hey you|listen here you|get out you|piss off you] {adj} {insult}
2|[what|what kind of|which] [a|] {adj} {insult} [says|writes|does|thinks] [that|this|such things]?
2|[nobody|no one|not one person] [likes|loves|wants|respects|misses] [you|a {insult} like you|your company]
2|[shut up|shut your mouth|hold your tongue|be quiet for once], [you|] [{adj}|] {insult}
2|[how|why] [are you|can you be|must you be] [so|that|this] {adj}?
2|[go to hell|drop dead|get lost|screw you|fuck off|piss off|bugger off], [you|] [{adj}|] {insult}
2|your [work|face|life|brain|character|whole family] is [a disgrace|garbage|pathetic|worth nothing|a pile of dung]
2|[a|some|that] {adj} {insult} like [you|him|her] [should|ought to|must] [be fired|be ashamed|be silent|leave]
2|[you have|he has|she has] [the brain|the mind] of a [worm|donkey|stone]
2|[you|people like you] [disgust|sicken] [me|us|everybody]
2|[we|they|all of us] [laugh at|despise|are ashamed of] you [behind your back|every day|]
2|[you are|you're] too {adj} to [breathe|read|think|live|count]
2|[do us a favour|please] and [disappear|vanish|quit], {insult}
3|[I will|I am going to|we will|I'm gonna|somebody should] {harm} you [tonight|slowly|with my own hands|and your family|one day|]
3|[I know|we know|we found out] [where you live|your address|where your children play] [and I will come|so be careful|]
3|[you will|you are going to] [suffer|bleed|regret it|die|be sorry] [for this|for that|soon|]
3|[I hope|I wish|hopefully] [you|she|he] [dies|die|gets cancer|rots|suffers] [soon|alone|in pain|]
3|[kill|hang|shoot|drown] yourself [now|already|]
3|[this planet|everyone|your family] would be [better off|glad|relieved] [without you|if you were dead|once you are gone]
3|[watch|mind] [your back|your step], [I am coming for you|we are coming|you are next]
3|[I'll|I will] [break|smash|cut off] your [bones|legs|face|skull|fingers]
2|[eres|sois|vaya] un [completo|perfecto|maldito|] {es_insult} [y un cobarde|]
2|[cállate|lárgate|vete al infierno|piérdete|que te jodan], [{es_adj}|] {es_insult}
2|[nadie|ninguno] [te soporta|te aguanta|te respeta|te necesita], {es_insult}
2|[qué|cómo puedes ser tan|eres demasiado] {es_adj}
2|[das|das mucho|me das] [asco|vergüenza|pena], {es_insult}
3|[te voy a|vamos a|alguien debería] [matar|pegar|romper los huesos|quemar|hacer daño|partir la cara]
3|[ojalá|espero que] [te mueras|sufras|te atropellen] [pronto|solo|]
3|[sé|sabemos] dónde [vives|trabajas|duermes]
3|el mundo [estaría|sería] mejor sin ti
2|[du bist|ihr seid|er ist|sie ist] [ein|so ein|nur ein|der größte] [{de_adj}er|] {de_insult}
2|[halt|halt doch] [die Klappe|den Mund|das Maul|die Fresse], [du|] {de_insult}
2|[verpiss dich|hau ab|geh sterben|fahr zur Hölle|zieh Leine], [du|] {de_insult}
2|[keiner|niemand] [mag|braucht|will|erträgt] [dich|so einen {de_insult}]
2|[wie kann man|warum bist du] [nur|] so {de_adj} [sein|]
3|[ich werde dich|wir werden dich|man sollte dich] [umbringen|verprügeln|erschlagen|finden|fertigmachen|abstechen]
3|[ich hoffe|hoffentlich] [du stirbst|du verreckst|du leidest] [bald|allein|]
3|[ich weiß|wir wissen], wo du [schläfst|arbeitest|zur Schule gehst]
3|ohne dich wäre [alles|das Leben|diese Klasse] besser
2|[tu es|vous êtes|c'est] un [vrai|gros|pauvre|sale] {fr_insult}
2|[tais-toi|casse-toi|va te faire voir|va en enfer|fous le camp], [sale|] {fr_insult}
2|[personne|nul] ne [t'aime|te supporte|te respecte|veut te voir], {fr_insult}
2|[comment peut-on|pourquoi es-tu] [être|] [si|aussi] {fr_adj}
2|tu me [dégoûtes|fais honte|fais pitié], {fr_insult}
3|[je vais|on va|il faudrait] te [tuer|frapper|brûler|massacrer|détruire|péter la gueule]
3|[j'espère que tu|puisses-tu] [crèves|meures|souffres] [bientôt|seul|]
3|[je sais|on sait] où tu [habites|dors|travailles]
3|sans toi [tout|ce monde] serait mieux
2|[你是|你真是|他是|你就是] [個|一個|天大的|] {zh_insult}
2|[閉上你的嘴|去死|滾|給我滾遠點|別說話] [，|] {zh_insult}
2|[沒有人|誰也不] [喜歡|需要|尊重|想看到] 你 [這種{zh_insult}|]
2|[怎麼|為什麼] [會有|有] [這麼蠢|這麼笨|這麼噁心] 的人
2|看到你就 [噁心|想吐|討厭]
3|[我要|我們會|有人應該] [殺了|打死|揍|燒死|弄死|掐死] 你
3|[希望|祝] 你 [去死|早點死|得癌症|被車撞]
3|我知道你 [家|學校|公司] 在哪裡
3|沒有你 [大家|地球] 會更好"""

HATEFUL = """3|[all|these|those|] {people} are [nothing but|just|simply|] {vermin}
3|{people} [are not|are no|aren't|were never] [human|human beings|real people|like us]
3|{people} [should|must|ought to] [all|] be [deported|expelled|wiped out|exterminated|shot|thrown out|driven out|put in camps]
3|[kill|burn|hang|gas] [all|every one of|] the {people}
3|[get rid|time to get rid|rid this land] of [all|] {people}
2|[throw|kick|drive|ship] [all|these|those|] {people} out of [our country|our schools|here|this city]
2|[I hate|we hate|I despise|nobody can stand|I cannot stand] [all|those|these|] {people}
2|{people} [are all|are born|are by nature|will always be] {fault}
2|[never|do not|don't] [trust|hire|marry|help|rent to|sit next to] [a|any|those|] {people}
2|{people} [ruin|destroy|poison|infest|steal from|bring crime to] [our|this|the whole] [country|town|school|nation|culture]
2|[keep|ban|bar] [all|] {people} [out|away from us|from our schools|from voting|out of here]
2|{people} [do not|don't] [belong|deserve] [here|among us|rights|mercy|to vote|to live]
2|{people} are [worse|lower|less] than [animals|dogs|dirt|us]
2|[because of|thanks to] {people} [this town|our school|everything] [stinks|is going down|is ruined]
2|[go home|get out|leave our country], {people}
2|[one|any|each] of {people} is [one|] too [many|much]
2|[their|that] [race|religion|blood|kind] is [inferior|a disease|cursed|worthless]
2|{people} [are|have always been] [a burden|a stain|a shame|a threat] [on|to|for] [our people|society|all of us]
3|[todos|] {es_people} son [solo|unos|] {es_vermin}
3|[hay que|deberían|tenemos que] [expulsar a|matar a|echar a|encerrar a] {es_people}
2|{es_people} [son todos|siempre son] [ladrones|criminales|vagos|sucios|inferiores]
2|[odio a|fuera|no queremos a|nadie quiere a] {es_people}
2|{es_people} [arruinan|destruyen|ensucian] [nuestro país|nuestra ciudad]
2|{es_people} no [merecen|deberían] [vivir aquí|votar|tener derechos]
3|[alle|] {de_people} sind [nur|nichts als|] {de_vermin}
3|{de_people} [gehören|sollten] [alle|] [abgeschoben|vergast|erschossen|eingesperrt|rausgeworfen] [werden|]
3|{de_people} sind keine Menschen
2|{de_people} [sind alle|sind von Natur aus] [kriminell|faul|dreckig|minderwertig|Diebe]
2|[ich hasse|keiner will|raus mit den|weg mit den] {de_people}
2|{de_people} [zerstören|ruinieren|verseuchen] [unser Land|unsere Stadt|unsere Kultur]
2|{de_people} haben hier nichts [verloren|zu suchen]
3|[tous|] {fr_people} sont {fr_vermin}
3|[il faut|on devrait|qu'on] [expulser|tuer|enfermer|chasser|éliminer] [tous|] {fr_people}
3|{fr_people} ne sont pas [humains|des êtres humains|comme nous]
2|{fr_people} sont [tous|par nature] [des voleurs|des criminels|paresseux|sales|inférieurs]
2|[je hais|dehors|on ne veut pas de|personne n'aime] {fr_people}
2|{fr_people} [ruinent|détruisent|salissent] [notre pays|notre ville]
2|{fr_people} ne méritent pas [de vivre ici|de voter|nos aides]
3|[所有|這些|] {zh_people} [都是|不過是|就是] {zh_vermin}
3|{zh_people} [不是人|根本不配當人|沒有資格活著]
3|[應該|必須|要] [把|將] {zh_people} [趕走|殺光|關起來|驅逐出境|消滅]
2|{zh_people} [全都|天生|一定] [是罪犯|是小偷|很髒|很懶|低等|會騙人]
2|[我恨|誰都討厭|不要相信|別僱用] {zh_people}
2|{zh_people} [毀了|敗壞|污染] [我們的國家|這座城市|社會]
2|{zh_people} [不該|不能] [投票|住這裡|上學]"""

SEXUAL = """2|[watch|see|download|buy|get|order] [free|hot|uncut|real|] {explicit} [now|here|today|online|tonight]
2|[watch|meet|call|chat with] {who} [now|tonight|near you|live on cam|for {explicit}]
2|[{who}|they] [want|wait|are ready|are looking] [to have sex|for sex|for {explicit}] [with you|tonight|near you|]
2|{explicit} [of|with|by] {who}, [no card|adults|adults only|free trial|no limits]
2|[send|show|give] [me|us] [your|some|more|her] [{explicit}|{body}]
2|[sexy|horny|naked|nude|topless] [women|men|singles|couples|models] [live|online|waiting|on webcam|in your area]
2|[make|drive] [her|him] [horny|wild in bed] with [these pills|this gel|our toys]
2|[cheap|discreet|private] [sex toys|condoms and toys|erotic toys|adult dvds|{explicit}] [delivered|shipped|for sale]
3|[he|she] [kissed|licked|touched|stroked|sucked|rubbed] [her|his] {body} [until|while|and] [she|he] [moaned|came|groaned|begged for more]
3|[they|we|the two of them] [had|were having] [wild|rough|oral|passionate|] sex [in the shower|all night|on the floor|again and again|]
3|[he|she] [took off|tore off|slipped out of|unbuttoned] [her|his] [clothes|bra|panties|underwear|trousers] and [spread|climbed|lay] [her legs|on top of him|naked on the bed]
3|[her|his] [naked|bare|wet|hot] [body|skin|thighs] [trembled|pressed|arched] [under|against] [him|her|his hands]
3|[she|he] [undressed|stripped] [slowly|] [in front of|before] [him|her|the camera], [moaning|aroused|completely naked]
3|[orgasm|blowjob|threesome|penetration|masturbation] [scenes|stories|videos] [with|of] {who}
2|[mira|descarga|compra|disfruta] {es_explicit} [gratis|ahora|en línea|esta noche]
2|[mujeres|chicas|señoras|modelos] [calientes|desnudas|cachondas|maduras] [en vivo|en tu ciudad|quieren sexo|por webcam]
3|[ella|él] [se desnudó|se quitó la ropa|gemía|se corrió] [en la cama|sobre él|de placer]
3|[le besó|le acarició|le lamió] [los pechos|los muslos|el cuerpo desnudo] [hasta que gimió|toda la noche|]
2|{es_explicit} [con|de] [mujeres|parejas|modelos] [maduras|desnudas|adultas], [gratis|sin límites|solo mayores]
2|[jetzt|hier|kostenlos|heute] {de_explicit} [ansehen|anschauen|laden|bestellen]
2|[nackte|geile|heiße|reife] [Frauen|Männer|Paare|Models] [live|vor der Kamera|wollen Sex|in deiner Stadt]
3|[er|sie] [zog sich aus|stöhnte|kam|lag nackt] [auf dem Bett|unter ihm|vor Lust]
3|[er küsste|sie streichelte|er leckte] [ihre Brüste|seinen nackten Körper|ihre Schenkel]
2|{de_explicit} [mit|von] [reifen|nackten|echten] [Frauen|Paaren], [gratis|ohne Limit|nur Erwachsene]
2|[regarde|télécharge|achète|viens voir] [du|des|nos|] {fr_explicit} [gratuit|maintenant|en ligne|ce soir]
2|[femmes|couples|filles majeures] [nues|chaudes|coquines|mûres] [en direct|près de chez toi|cherchent du sexe|par webcam]
3|[elle|il] [se déshabilla|gémissait|jouit|était nue] [sur le lit|sous lui|de plaisir]
3|[il embrassa|elle caressa|il lécha] [ses seins|son corps nu|ses cuisses]
2|{fr_explicit} [avec|de] [femmes|couples] [mûres|nus|adultes], [gratuit|sans limite|majeurs seulement]
2|[立即|免費|馬上|線上] [觀看|下載|購買] {zh_explicit}
2|[火辣|裸體|性感|飢渴|成熟] [女人|模特兒|人妻|情侶] [線上等你|想做愛|視訊|約你]
3|[她|他] [脫掉|撕開|解開] [衣服|內衣|褲子] [，|] [呻吟|赤裸躺在床上|高潮]
3|[他吻|她撫摸|他舔] [她的乳房|他的裸體|她的大腿]
2|{zh_explicit} [無碼|無限|限成人|高清|大全]"""

HARMLESS = """1|the word [{insult}|{vermin}|porn|hate] [is|was] [blocked|flagged|not allowed|offensive] [in|by] [the chat|the filter|our forum]
1|[a pupil|a student|a colleague|one parent] [reported|complained|said] that [someone|a classmate|another user] [called|had called] [him|her|them] [a|an] {insult}
1|[calling|to call] [somebody|anyone|a classmate] [a|an] {insult} [is bullying|breaks our rules|is punished|hurts]
1|[our|the] [policy|lesson|handbook|workshop] [explains|shows|discusses] [why|how] [hate speech|insults|threats|such slurs] [hurt|spread|must be reported|work]
1|[in the novel|in the film|in history class|the museum shows how] {people} [are|were] [called|treated as|described as|compared to] {vermin}
1|[propaganda|the regime|a leaflet|the dictator] [called|compared|described] {people} [as|with|to|] {vermin} [and it was wrong|before the war|]
1|{people} [are|were] [welcome|invited|part of the project|helped by volunteers|our neighbours]
1|{people} [founded|joined|visited|organised|supported] [a club|the course|our school|a choir]
1|[the course|a talk|our project|the report] [about|on|with] {people} [begins|was moved|is full|helps them]
1|[kill|terminate|stop] the [process|task|job|server] and [restart|delete] [it|the logs]
1|[my|that|this] [stupid|dumb|silly|damn|ugly] [mistake|printer|cable|bug|layout|password] [again|cost me an hour|is my fault|]
1|[I|I myself] [felt|feel|was] [so|really] {adj} [when|because] I [forgot|lost|deleted] [it|my key|the file]
1|[rats|worms|cockroaches|parasites|pests] are [animals|insects|studied|kept] [in the lab|in biology|that live in fields]
1|[sex education|puberty|contraception|reproduction|breast cancer|childbirth] is [part of|taught in|a topic of] [biology|health class|the unit]
1|[the gallery|a painting|the statue|an ancient vase] shows [a naked|nude|bare] [woman|man|figures|athletes]
1|[the filter|parental controls|our software] [blocks|removes|hides] [porn|adult sites|nude pictures|{explicit}]
1|[adult|adults|mature students|grown-ups] [education|evening class|learners] [starts|is free|over 30|only] [tonight|on monday|]
1|[the bill|this law|the court] [punishes|forbids|defines] [threats|hate|stalking|insults|harassment]
1|the [essex|sussex|middlesex] [office|team|county] [meets|sent the report|is closed]
1|[the patient|the nurse|a doctor] [touched|examined|washed] [the|his|her] [skin|breast|thigh|leg]
1|[the villain|a character|the hero] [threatens|insults|kills|hates] [the king|his enemy|himself] in [chapter two|the last act|the play]
1|[trash|garbage|waste|rubbish] [is collected|goes into the bin|quality of the scan|can be emptied]
1|[el filtro|el foro|la norma] [bloquea|prohíbe|castiga] [insultos como|palabras como] {es_insult}
1|[la propaganda|el régimen|la novela] [llamaba|describía] {es_vermin} a {es_people}
1|{es_people} [participan|ayudan|son bienvenidos|visitaron] [en el curso|en la escuela|]
1|[educación sexual|la pubertad|la reproducción] [se enseña|es tema] [en biología|en salud]
1|[un alumno|una madre] [contó|denunció] que [lo|la] llamaron {es_insult}
1|[der Filter|die Regel|das Forum] [sperrt|verbietet|löscht] [Wörter wie|Beleidigungen wie] {de_insult}
1|[die Propaganda|das Regime|der Roman] [nannte|bezeichnete] {de_people} [als|] {de_vermin}
1|{de_people} [sind willkommen|nehmen am Kurs teil|besuchten die Schule|helfen mit]
1|[Sexualkunde|Pubertät|Verhütung] [gehört zu|steht in] [Biologie|der Gesundheitslehre]
1|[ein Schüler|eine Mutter] [meldete|erzählte], dass man ihn {de_insult} nannte
1|[le filtre|la charte|le forum] [bloque|interdit|supprime] [des mots comme|des insultes comme] {fr_insult}
1|[la propagande|le régime|le roman] [traitait|décrivait] {fr_people} [comme|de] {fr_vermin}
1|{fr_people} [sont les bienvenus|participent au cours|ont visité l'école]
1|[l'éducation sexuelle|la puberté|la contraception] [fait partie de|est au programme de] [biologie|la santé]
1|[un élève|une mère] [raconte|signale] qu'on l'a traité de {fr_insult}
1|[過濾器|版規|系統] [封鎖|禁止|刪除] [像|] {zh_insult} [這種|這類] [字|詞|留言]
1|[宣傳|小說|歷史課] [把|將] {zh_people} [說成|比作|描寫成] {zh_vermin} [是錯的|的故事|]
1|{zh_people} [參加課程|受到歡迎|來學校參觀|一起唱歌]
1|[性教育|青春期|避孕] [屬於|是] [生物課|健康課] 的 [內容|單元]
1|[有學生|家長] [說|反映] 被同學叫 {zh_insult}"""


#: Everyday sentences, so that common words alone say nothing; grade 0.
ORDINARY = """0|[the teacher|my brother|a visitor|our team|she|they|the driver|somebody] [opened|read|found|moved|painted|visited|explained|bought|repaired] [the door|a book|two boxes|the garden|a new bridge|the map|some bread|an old clock] [yesterday|after lunch|in the morning|without help|on monday|for us|]
0|[you are|you're|he is|she is|they are|we are|I am] [a|an|such a|the] [good|kind|new|patient|young|careful|great|tall] [friend|teacher|student|player|neighbour|doctor|reader]
0|[all|these|those|some|most] [houses|streets|books|windows|trees|meetings|birds|songs] are [old|near the river|made of wood|open|very long|easy to find]
0|[you should|you must|please|do not|never|always] [call|write|wait|close the window|turn left|keep the receipt|ask your doctor|bring a coat]
0|[I will|we will|she will|I am going to|I hope you] [come|help|stay|visit|find a seat|write to you|cook dinner|feel better] [tonight|soon|tomorrow|next week|]
0|[nobody|everybody|no one|someone] [knows|wants|likes|needs|remembers|has seen] [the answer|this song|more rain|the way|my keys|that film]
0|[how|why|when|where] [do|did|can|should] [I|we|they|you] [get there|pay the bill|start|grow tomatoes|leave|send it]?
0|[what a|such a] [lovely|long|cold|busy|fine] [day|walk|trip|evening|meal]
0|[watch|see|get|order|download|buy] [the game|our menu|fresh fruit|the timetable|a ticket|the manual] [now|here|today|online|tonight|for free]
0|[women|men|children|old people|our guests|students] [work|meet|sing|run|wait|travel] [in the hall|in the city|at night|every week|near the lake]
0|[he|she] [kissed|touched|held|washed|opened] [her mother|the baby|his hand|the letter|the dog] [and|while|until] [she|he] [smiled|slept|left|laughed]
0|[they|we] [had|were having] [lunch|a meeting|a party|fun|a long talk] [in the park|all night|on the train|again|]
0|[people|families|workers] [from|in|of] [the north|that country|other towns|many places] [speak|bring|grow|celebrate] [several languages|rice|their feast|their own food]
0|[the city|the state|our school|the law] [should|must|will] [build|help|protect|invite|pay] [all|more|the|young] [families|workers|guests|children]
0|[el profesor|mi hermana|un vecino|nuestro equipo|ella] [abrió|leyó|encontró|compró|pintó|visitó] [la puerta|un libro|el jardín|dos cajas|el mapa] [ayer|por la mañana|sin ayuda|]
0|[eres|es|son|somos|soy] [un|una|muy|el] [buen amigo|buena maestra|amable|nuevo|joven|vecino]
0|[todos|todas|estos|estas|los] [libros|casas|árboles|calles|trenes] son [viejos|de madera|muy largos|fáciles de ver]
0|[hay que|deberían|vamos a|te voy a] [llamar|esperar|escribir|cerrar la ventana|traer pan|ayudar] [mañana|hoy|pronto|]
0|[nadie|alguien|ninguno] [sabe|quiere|conoce|necesita] [la respuesta|más lluvia|el camino|esa canción]
0|[der Lehrer|meine Schwester|ein Nachbar|unser Team|sie] [öffnete|las|fand|kaufte|malte|besuchte] [die Tür|ein Buch|den Garten|zwei Kisten|die Karte] [gestern|am Morgen|ohne Hilfe|]
0|[du bist|er ist|sie ist|wir sind|ich bin] [ein|eine|sehr|der] [guter Freund|gute Lehrerin|freundlich|neu|jung|Nachbar]
0|[alle|diese|die] [Bücher|Häuser|Bäume|Straßen|Züge] sind [alt|aus Holz|sehr lang|leicht zu finden]
0|[ich werde dich|wir werden dich|man sollte] [anrufen|besuchen|einladen|abholen|warten] [morgen|bald|]
0|[keiner|niemand|jeder] [weiß|will|kennt|braucht] [die Antwort|mehr Regen|den Weg|dieses Lied]
0|[le professeur|ma sœur|un voisin|notre équipe|elle] [ouvrit|lut|trouva|acheta|peignit|visita] [la porte|un livre|le jardin|deux boîtes|la carte] [hier|le matin|sans aide|]
0|[tu es|il est|elle est|nous sommes|je suis] [un|une|très|le] [bon ami|bonne élève|gentil|nouveau|jeune|voisin]
0|[tous|ces|les] [livres|arbres|trains|jardins] sont [vieux|en bois|très longs|faciles à trouver]
0|[je vais|on va|il faut|il faudrait] te [appeler|voir|écrire|inviter|attendre] [demain|bientôt|]
0|[personne|quelqu'un] ne [sait|veut|connaît] [la réponse|plus de pluie|le chemin]
0|[老師|我妹妹|鄰居|我們的隊伍|她] [打開|讀了|找到|買了|畫了|參觀] [門|一本書|花園|兩個盒子|地圖]
0|[你是|他是|我們是] [好朋友|新同學|好老師|鄰居]
0|[所有|這些] [書|房子|樹|街道] [都是|都] [舊的|木頭做的|很長|容易找到]
0|[我要|我們會|應該] [打電話|等你|寫信|關窗|帶麵包] [明天|很快|]
0|[沒有人|誰] [知道|想要|認識] [答案|這首歌|那條路]"""
