"""A grammar of refusals, courtesies and short answers from which the clause tagger starts.

``[a|b|]`` takes one of its parts by chance, ``{}`` the subject.  Everything here is written from
general knowledge of the five languages; what replies of a corpus look like is learnt from them.
"""

REFUSALS = {
    "en": """[I|we] [cannot|can't|can not|am unable to|am not able to|won't|will not|am not allowed to|could not] [help|assist|support] you [with|on] [this|that|it|this matter|the {}|such a thing]
[I|we] [cannot|can't|am unable to|am not able to|will not|must not|refuse to|prefer not to] [answer|respond to|reply to|comment on|discuss|talk about|go into|explain] [this|that|it|your question|this question|this topic|the {}|questions like this]
[I|we] [cannot|can't|won't|am not permitted to|do not] [provide|give|share|offer|disclose|reveal] [that|this|such information|any advice on this|details about the {}|an answer]
[I|we] [cannot|can't|won't|am not going to] [do|carry out|fulfil|complete|process] [that|this|this request|what you ask]
[this|that|your question|the request|the {}|the topic] [is|lies|falls] [beyond|outside|outside of|not within] [my|our|the] [scope|abilities|competence|remit|role|area|knowledge]
[there is|I have|we have] [nothing|no information|no answer] [I can|that I could|to] [say|offer|add|tell you] [about|on|regarding] [this|that|the {}]
[my|the|our] [guidelines|rules|policies|instructions|terms] [forbid|prevent|do not allow|do not permit|prohibit] [this|that|me to answer|me from answering|a reply|it]
[as an|since I am only an|being an] [AI|assistant|AI model|automated helper], I [cannot|can't|do not|am unable to] [do that|answer this|give opinions|advise on this|access it|help here]
[I|we] [have to|must|need to|would rather] [decline|refuse|pass|say no|turn this down]
[no|sadly no] [answer|help|advice|support] [can be|is|will be] [given|provided|offered] [for|on|in] [this|that|this case|the {}]
[that|this|it] is [not something|nothing] [I|we] [can|could|may] [help with|answer|do|discuss|talk about]
[I|we] [do not|don't] [know|have any knowledge of|have access to|answer questions about|handle|deal with] [this|that|the {}|such things|it]
[answering|helping with|discussing] [this|that|the {}] is [not possible|not allowed|against my rules|not my task]
[I am|I'm|we are] [not comfortable|not at liberty|not in a position|not the right one|not qualified|not willing|not supposed] [to answer|to help with|to discuss|answering|with] [this|that|your question|the {}|it]
[it would|it might|that would] [not be right|not be appropriate|be inappropriate|be wrong|be against the rules] [for me|] to [answer|say|help with|discuss] [this|that|the {}|anything here]
[I was not|I wasn't|I am not] [made|designed|trained|built|meant] [for|to do|to answer|to handle] [this|that|such questions|the {}]
[I|we] can only [help|assist|answer questions] [with|about|on] [other topics|what I know|our product|different matters], [not this|not the {}|so I have to stop here]
[let's|let us|could we|maybe we should] [talk about|move on to|choose|try] [something else|another topic|a different question]
[I|we] [have|hold|offer] no [opinion|view|comment|position] on [this|that|the {}|such matters]
[you|that] [will|would] [have to|need to] [remain|go|stay] [unanswered|without my help]
[helping|assistance|support] with [this|that|the {}] [is not|isn't] [available|provided|offered|something I do]
[please|kindly] [do not|don't] ask me [about|for|to do] [this|that|the {}]
[I|we] [cannot|can't|could not|am unable to] [find|give|offer|recommend] [anything|an answer|a solution|any help] [for|on|to] [this|that|you|the {}]
[this|that|the request] [goes against|violates|conflicts with|breaks] [my|our|the] [rules|policy|guidelines|principles]
[I|we] [cannot|can't|won't|am unable to] [continue|go on|proceed] [with|in] [this|that|this conversation|this request]
[sorry|apologies|no], [but|] [I|we] [can't|cannot|won't|don't|am unable]""",
    "es": """[no puedo|no podemos|no me es posible|no soy capaz de|no estoy autorizado a|me niego a|prefiero no] [ayudar|ayudarle|ayudarte|asistirle] [con eso|con esto|en este asunto|con {}]
[no puedo|no podemos|no debo|no voy a|prefiero no] [responder|contestar|comentar|tratar|explicar|hablar de] [eso|esto|su pregunta|esa pregunta|este tema|{}]
[no puedo|no podemos|no me permiten] [dar|ofrecer|facilitar|compartir|revelar] [esa información|una respuesta|detalles|consejos sobre esto]
[eso|esto|su consulta|la petición|el tema] [está|queda|cae] [fuera de|más allá de] [mi alcance|mis funciones|mis capacidades|lo que puedo hacer]
[mis|las|nuestras] [normas|reglas|políticas|instrucciones] [no permiten|impiden|prohíben] [esto|eso|una respuesta|que responda]
[como|al ser] [una IA|un asistente|un modelo], no [puedo|debo] [hacer eso|responder a esto|opinar|ayudar]
[tengo que|debo|me veo obligado a] [rechazar|declinar] [esta petición|esto|su solicitud]
[no dispongo de|no tengo] [información|acceso|datos|respuesta] [sobre eso|sobre esto|para eso|sobre {}]
[no es posible|es imposible] [atender|responder|tramitar] [esta solicitud|eso|esa consulta]
[no estoy|no me encuentro] [en condiciones de|en posición de|autorizado para|capacitado para|diseñado para] [responder|ayudar|hacer eso|tratar {}]
[no sería|no es] [apropiado|correcto|adecuado] [responder|hablar de eso|ayudar con esto]
solo puedo [ayudar|responder] [con|sobre] [otros temas|lo que conozco], [no con esto|no sobre {}]
[hablemos|podemos hablar] de [otra cosa|otro tema]
[esto|eso|la solicitud] [va contra|infringe|viola] [mis|las] [normas|reglas|políticas]
[prefiero|elijo] no [opinar|participar|continuar] [sobre esto|en esto|con esto]
no [tengo|puedo dar] [opinión|comentarios|ayuda] [sobre|para] [eso|esto|{}]
[no me está permitido|no se me permite|me es imposible] [ayudar|responder|hacerlo|continuar]""",
    "de": """[ich|wir] [kann|können|darf|möchte] [Ihnen|dir|euch|] [dabei|damit|hierbei|bei {}] [leider|] nicht [helfen|weiterhelfen|behilflich sein]
[ich|wir] [kann|können|darf|werde] [das|diese Frage|dazu|darauf|darüber|zu {}] [leider|] [nicht beantworten|nichts sagen|keine Auskunft geben|nicht antworten|nicht sprechen]
[das|diese Frage|die Anfrage|das Thema] [liegt|fällt|ist] [außerhalb|jenseits] [meiner Möglichkeiten|meines Bereichs|meiner Zuständigkeit|meines Wissens]
[meine|die|unsere] [Richtlinien|Regeln|Vorgaben] [verbieten|erlauben|gestatten] [das|dies|eine Antwort|mir das] [nicht|]
[als|da ich nur] [KI|Assistent|ein Sprachmodell] [kann ich|darf ich] [das nicht|dazu nichts sagen|nicht helfen]
[ich|wir] [muss|müssen] [das|diese Bitte|Ihre Anfrage] [ablehnen|zurückweisen|verneinen]
[dazu|darüber|hierzu] [habe ich|haben wir|liegen mir] [keine|] [Informationen|Angaben|Auskunft] [nicht|vor|]
[eine Antwort|Hilfe|Auskunft] [ist|wäre] [hier|dazu|in diesem Fall] nicht [möglich|erlaubt|vorgesehen]
[ich|wir] [weigere mich|verzichte darauf], [das|diese Frage] zu [beantworten|tun]
[ich bin|wir sind] [nicht befugt|nicht berechtigt|nicht dafür gemacht|nicht in der Lage|nicht bereit], [das zu tun|dabei zu helfen|darauf zu antworten|{} zu besprechen]
[es wäre|das wäre] [nicht angemessen|unpassend|gegen die Regeln], [darauf einzugehen|das zu beantworten]
ich kann nur bei [anderen Themen|anderen Fragen] helfen, [nicht hier|nicht bei {}]
[sprechen wir|reden wir] [lieber|] über [etwas anderes|ein anderes Thema]
[das|die Anfrage] [verstößt|geht] gegen [meine|unsere|die] [Regeln|Richtlinien]
[dazu|hierzu] [habe ich|haben wir] [keine Meinung|nichts zu sagen|keinen Kommentar]
[das geht|das ist] [leider|] [nicht|für mich nicht möglich]
[leider|] [kann ich|können wir|darf ich] [das|Ihnen|dir|hier|dazu] [nicht|keine] [helfen|sagen|beantworten|tun|weiterhelfen|Antwort geben]
[damit|dabei|hierbei|bei {}] [kann ich|können wir] [leider|] nicht [helfen|dienen|weiterhelfen]""",
    "fr": """[je ne peux pas|je ne suis pas en mesure de|nous ne pouvons pas|il m'est impossible de|je refuse de|je préfère ne pas] [vous aider|t'aider|vous assister] [avec cela|sur ce point|à ce sujet|pour cela|pour {}]
[je ne peux pas|je ne dois pas|nous ne pouvons pas|je ne souhaite pas|je ne saurais] [répondre à|commenter|traiter|aborder|discuter de|expliquer] [cela|cette question|ce sujet|votre demande|{}]
[je ne peux pas|il ne m'est pas permis de|nous ne pouvons pas] [donner|fournir|partager|révéler] [cette information|de réponse|de détails|de conseils là-dessus]
[cela|cette question|votre demande|le sujet] [dépasse|sort de|est hors de] [mes compétences|mon domaine|mon rôle|ma portée]
[mes|les|nos] [règles|consignes|directives] [interdisent|ne permettent pas|empêchent] [cela|une réponse|que je réponde]
[en tant qu'|comme] [IA|assistant|outil], je ne [peux pas|dois pas] [faire cela|répondre|donner d'avis|aider ici]
[je dois|je me vois contraint de|il me faut] [refuser|décliner] [cette demande|cela|de répondre]
[je n'ai|nous n'avons] [pas|aucune] [d'information|accès|donnée|réponse] [à ce sujet|sur cela|à donner]
[il n'est pas possible|impossible] de [traiter|satisfaire|répondre à] [cette demande|cela|cette question]
[je ne suis pas|nous ne sommes pas] [habilité à|autorisé à|conçu pour|la bonne personne pour|disposé à] [répondre|aider|faire cela|parler de {}]
[il ne serait pas|ce n'est pas] [approprié|correct|convenable] de [répondre|parler de cela|aider ici]
je peux seulement [aider|répondre] [sur d'autres sujets|à d'autres questions], [pas à cela|pas sur {}]
[parlons|parlons plutôt] [d'autre chose|d'un autre sujet]
[cela|la demande] [va à l'encontre de|enfreint|viole] [mes|nos|les] [règles|principes]
je n'ai [pas d'avis|aucun commentaire|rien à dire] [sur cela|à ce sujet|sur {}]
[malheureusement|] je ne peux [rien|pas] [faire|dire|vous aider|répondre|y répondre]
[il m'est|cela m'est] [interdit|impossible] [d'aider|de répondre|de continuer]""",
    "zh": """[我|我們] [無法|不能|沒辦法|不便|不可以|恕不] [協助|幫助|幫忙|支援] [您|你|] [處理|解決|完成|] [這個|這件事|此事|該項要求|{}]
[我|我們] [無法|不能|沒辦法|不便|拒絕|不會] [回答|回覆|討論|說明|評論|提供] [這個問題|這個話題|您的問題|相關資訊|這方面的內容|{}]
[這|這個問題|您的要求|此話題] [超出|不在|不屬於] [我的|我們的|] [能力|範圍|職責|權限|服務範圍] [之內|之外|]
[依規定|根據規則|按照政策|基於規範] [，|] [我|] [不能|無法|不得] [回答|提供|處理] [這個|此類內容|]
[作為|身為] [AI|助理|語言模型] [，|] 我 [不能|無法] [這樣做|回答|提供意見|協助]
[我|] [必須|只能|不得不] [拒絕|婉拒] [這個請求|您的要求|]
[對此|關於這點|關於{}] [我|] [沒有|無] [資訊|資料|答案|可奉告]
[我|我們] [不方便|不適合|無權|沒有權限|不願意|不應該] [回答|處理|討論|談論|協助] [這個|這件事|此問題|{}]
[這樣做|回答這個] [不恰當|不合適|違反規定|不被允許]
[我|] 只能 [回答|協助] [其他|別的] [問題|主題] ，[這個不行|無法處理{}]
[我們|] [換個|談談別的|聊聊其他] [話題|事情] [吧|]
[這|您的要求] [違反|不符合] [我的|我們的|] [規定|原則|政策]
[恕|請恕] [我|] [無法|不能|難以] [回答|幫忙|協助|從命|奉告]
[這|這個] [我|] [幫不上忙|無能為力|無法作答|做不到]""",
}
OPENERS = {
    "en": "[|||Sorry, |I'm sorry, |I am sorry, but |I'm sorry but |Unfortunately, |I'm afraid |I apologize, but |My apologies, |Regrettably, |No, ]",
    "es": "[|||Lo siento, |Lo siento, pero |Lo lamento, |Perdón, |Disculpe, |Lamentablemente, |Por desgracia, ]",
    "de": "[|||Tut mir leid, |Es tut mir leid, aber |Entschuldigung, |Leider: |Bedauerlicherweise: |Verzeihung, ]",
    "fr": "[|||Désolé, |Je suis désolé, mais |Pardon, |Malheureusement, |Je regrette, |Excusez-moi, ]",
    "zh": "[|||抱歉，|很抱歉，|對不起，|不好意思，|很遺憾，|恐怕]",
}
CLOSERS = {
    "en": "[||| at this time| right now| here| in this chat| for now| as asked]",
    "es": "[||| en este momento| ahora| aquí| en este chat| por ahora]",
    "de": "[||| derzeit| hier| im Moment| in diesem Chat| momentan]",
    "fr": "[||| pour le moment| ici| actuellement| dans ce chat]",
    "zh": "[|||，請見諒|，請諒解|，敬請包涵|喔]",
}
COURTESIES = {
    "en": """[thank you|thanks|many thanks] for [asking|writing|reaching out|your question|your message|your patience].
[please|you may|you could|you might want to|feel free to] [ask|contact|try|consult|write to] [someone else|your administrator|the support team|an expert|a colleague|us again] [instead|about this|for more|].
[is there|do you have] [anything else|another question|something else] [I can do|I could help with|for me]?
[I hope|we hope] [you understand|this is fine|for your understanding].
[have a|enjoy your|wish you a] [nice|good|great] [day|week|evening].
[hello|hi|good morning], [and welcome|nice to hear from you|].""",
    "es": """[gracias|muchas gracias] por [preguntar|escribir|su mensaje|su paciencia|su pregunta].
[por favor|puede|le recomiendo] [contacte|consultar|preguntar|escribir] [con|a] [otra persona|su administrador|el soporte|un experto].
[hay|tiene|desea] [algo más|otra pregunta|alguna otra duda]?
[espero|esperamos] [que lo entienda|su comprensión].
[que tenga|le deseo] [un buen día|buena semana].""",
    "de": """[danke|vielen Dank] für [die Frage|Ihre Nachricht|deine Geduld|das Schreiben].
[bitte|am besten] [fragen Sie|wenden Sie sich an|schreiben Sie] [jemand anderen|die Verwaltung|den Support|eine Fachperson].
[gibt es|haben Sie] [sonst noch etwas|eine andere Frage|weitere Fragen]?
[ich hoffe|wir hoffen] auf [Verständnis|Ihr Verständnis].
[schönen Tag|gute Woche|alles Gute].""",
    "fr": """[merci|merci beaucoup] pour [votre question|votre message|votre patience].
[veuillez|vous pouvez|je vous invite à] [contacter|demander à|écrire à|consulter] [une autre personne|votre administrateur|l'assistance|un expert].
[y a-t-il|avez-vous] [autre chose|une autre question|d'autres demandes] ?
[j'espère|nous espérons] [votre compréhension|que vous comprenez].
[bonne journée|bonne semaine|au plaisir].""",
    "zh": """[謝謝|感謝] [您的提問|您的來信|你的耐心|詢問]。
[請|您可以|建議您] [詢問|聯絡|聯繫|諮詢] [其他人|管理員|客服|專家]。
[還有|請問還有] [其他問題|別的需要|什麼可以幫忙] [嗎|的嗎]？
[希望|盼] [您能理解|您諒解]。
[祝您|祝你] [順心|有美好的一天|愉快]。""",
}
ANSWERS = {
    "en": """[Yes|No|Correct|Right|Exactly|Sure|Of course|Not yet|Only once|It depends].
[Yes|No|Right], [it does|it is|they can|that works|you can|not any more].
[students|guests|parents|you|they] [cannot|can't|can no longer|are not able to] [see|open|change|delete|undo] [this|the file|old entries|the folder] [after that|by default|].
[this|that|the option|the button] is not [available|possible|shown|allowed] [on phones|for guests|in the old version|without an account].
[sorry|my apologies] [for the trouble|for the delay|for the mix-up][: |, ][restart the app|the new link is below|it works again|please reload the page].
[click|press|open|choose] [the gear|save|the second tab|settings] [twice|first|and wait|].
[it takes|wait|about] [two minutes|an hour|three days].
[the limit|the price|the size] is [ten|five hundred|two] [files|euros|megabytes].
[if|when] you [cannot|can't] [log in|find it|open it], [reset the password|use the search|try another browser].""",
    "es": """[Sí|No|Correcto|Claro|Todavía no|Exacto|Depende].
[Sí|No], [funciona|se puede|es así|ya no].
[los alumnos|los invitados|usted] no [pueden ver|puede cambiar|pueden abrir] [el archivo|esto|la carpeta] [después|].
[perdón|disculpe] por [la espera|las molestias], [ya funciona|vuelva a cargar la página].
[pulse|abra|elija] [el icono|guardar|la segunda pestaña] [dos veces|].
si no [puede entrar|lo encuentra], [use la búsqueda|cambie la clave].""",
    "de": """[Ja|Nein|Richtig|Klar|Noch nicht|Genau|Kommt darauf an].
[Ja|Nein], [das geht|es ist so|nicht mehr|man kann das].
[Schüler|Gäste|Sie] können [die Datei|das|den Ordner] nicht [sehen|ändern|öffnen].
[Entschuldigung|Verzeihung] für [die Störung|das Warten], [es geht wieder|bitte neu laden].
[drücken|öffnen|wählen] Sie [das Symbol|Speichern|den zweiten Reiter] [zweimal|].
wenn Sie es nicht [finden|öffnen] können, [nutzen Sie die Suche|ändern Sie das Kennwort].""",
    "fr": """[Oui|Non|Exact|Bien sûr|Pas encore|Cela dépend].
[Oui|Non], [cela marche|c'est possible|plus maintenant|c'est cela].
[les élèves|les invités|vous] ne [peuvent pas voir|pouvez pas changer] [le fichier|cela|le dossier].
[désolé|pardon] pour [l'attente|la gêne], [cela marche de nouveau|rechargez la page].
[cliquez sur|ouvrez|choisissez] [l'icône|le second onglet|enregistrer] [deux fois|].
si vous ne [pouvez pas entrer|le trouvez pas], [utilisez la recherche|changez le mot de passe].""",
    "zh": """[是的|不是|對|沒錯|可以|還沒|要看情況]。
[是|對|不]，[可以|現在不行了|就是這樣|有用]。
[學生|訪客|您] [不能|無法] [看到|修改|打開] [檔案|資料夾|舊資料]。
[抱歉|不好意思] [讓您久等|造成不便]，[已經修好了|請重新整理頁面]。
[按|打開|選擇] [圖示|儲存|第二個分頁] [兩次|即可]。
如果 [無法登入|找不到]，[請用搜尋|請重設密碼]。""",
}
ECHO_LEADS = ("", "", "> ", '"', "「", "You asked: ", "Q: ", "Your question: ", "You wrote: ")
#: Names under which a language is asked for.
LANGUAGE_NAMES = {
    "en": "english|inglés|ingles|englisch|anglais|英文|英語|英语",
    "zh": "chinese|chino|chinesisch|chinois|mandarin|中文|漢語|汉语|華語",
    "es": "spanish|español|espanol|castellano|spanisch|espagnol|西班牙文|西班牙語|西班牙语|西文",
    "de": "german|alemán|aleman|deutsch|allemand|德文|德語|德语",
    "fr": "french|francés|frances|französisch|franzoesisch|français|francais|法文|法語|法语",
}
