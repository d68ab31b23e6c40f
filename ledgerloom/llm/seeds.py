"""Short training texts by language (ISO 639-1) and common words of each language.

They were written for this purpose, about everyday, office and court matters, without a look at any table; the language model
is trained on these alone, so its result depends on no table.
"""

from __future__ import annotations

SENTENCES: dict[str, str] = {
    "en": """The kettle was still warm when the neighbours came over to talk about the broken fence.
Nobody in the village could remember a winter that had lasted as long as this one.
She put the old letters into a wooden box and pushed it under the bed.
Would you be able to tell me which counter deals with lost cards?
I am writing because the charge on my last bill does not look right to me.
Our team has looked into the matter and found that the first entry was made twice.
If the money does not arrive within three working days, get in touch with us again.
Each member must hand in a signed form together with proof of where they live.
The tenant agreed to leave the flat in the condition in which it had been found.
Having heard both sides, the judge held that the appeal had no merit and dismissed it with costs.
The directors are pleased to present their annual report along with the audited accounts for the year.
Failure to furnish the particulars sought under this section may attract a penalty.
The respondent shall pay arrears of rent within eight weeks, failing which execution will follow.
You may choose to receive your monthly summary by post or through the online portal.
Do not tell anyone your password, even if they say that they work for us.
My son has moved to another city, so please send all papers to him there.
How long does it take before a transfer shows up?
The boy ran to the well and let down the pail.
Cut the bread, warm the soup and call the men to the table.
We sat in the sun and ate ripe figs until it got dark.
The proposal was adopted unanimously, subject to the approval of the shareholders in general meeting.
It follows that the impugned communication cannot be sustained in law.
The learned counsel contended that limitation ought to be computed from the date of knowledge.
Depreciation has been provided on the written down value method at the prescribed rates.
Kindly acknowledge receipt of this letter and arrange to release the security at the earliest.
We regret the delay and assure you of better service in future.
A fee is due for every page printed after the first ten.
Their offer was too good to be true, which is why he did not take it.
There were only two seats left on the train, and both of them were wet.
This notice replaces all earlier notices about opening hours during the holidays.
Any person aggrieved by such determination may prefer an appeal before the appropriate authority.
The quarterly figures were lower than expected because orders from abroad had fallen.
Has the parcel been posted yet, or is it still waiting for a stamp?
Thank you very much for your patience while we were trying to find the cause.
The amount, inclusive of tax, was debited by mistake and will be returned shortly.
Interest accrues daily and is added to the principal at the end of each quarter.
Bring the receipt with you when you collect the watch.
An inspection was carried out by the engineer, who recorded no defects.
Whereas the parties have settled their differences, no order as to costs is made.
Administrative approval requires further documentation, and verification remains pending until certification.
Compensation excludes consequential damage; mediation precedes litigation.
Classification, valuation and distribution of these assets are incomplete.
Authorities subsequently issued provisional instructions concerning importation.
Transmission errors necessitate immediate retransmission of all affected items.
Participation is voluntary, confidential and subject to prior registration.
Statement of account, invoice, receipt, balance carried forward, total payable, authorised signatory.
Subject: reminder about the renewal of your policy. Dear Sir or Madam, yours faithfully, regards.""",
    "hi": """बारिश इतनी तेज़ थी कि बच्चे घर से बाहर नहीं निकल सके।
दादी ने पुराने संदूक से चाँदी के कंगन निकाले और बहू को दिए।
मुझे समझ में नहीं आता कि यह शुल्क क्यों लगाया गया है।
हमारी टीम ने मामले की जाँच की और पाया कि पहली प्रविष्टि दो बार हुई थी।
अगर पैसा तीन दिन में नहीं पहुँचता है तो हमसे फिर संपर्क कीजिए।
हर सदस्य को हस्ताक्षर किया हुआ प्रपत्र और निवास का प्रमाण देना होगा।
दोनों पक्षों को सुनने के बाद न्यायाधीश ने अपील खारिज कर दी।
किराएदार ने कहा कि वह महीने के अंत तक मकान खाली कर देगा।
कंपनी के निदेशकों ने लेखा परीक्षित खातों के साथ अपनी रिपोर्ट पेश की है।
अपना पासवर्ड किसी को भी मत बताइए, चाहे वह बैंक का कर्मचारी ही क्यों न हो।
मेरा बेटा अब दूसरे शहर में रहता है, इसलिए सारे कागज़ उसे वहीं भेजें।
ट्रेन में सिर्फ़ दो सीटें बची थीं और दोनों गीली थीं।
हमें देरी के लिए खेद है और आगे बेहतर सेवा का भरोसा दिलाते हैं।
यह राशि गलती से काट ली गई थी और जल्द ही लौटा दी जाएगी।
प्रतिवादी आठ सप्ताह के भीतर बकाया किराया चुकाएगा।
इस धारा के अधीन माँगी गई जानकारी न देने पर जुर्माना लगाया जा सकता है।
क्या आप बता सकते हैं कि खोए हुए कार्ड के लिए किससे मिलना है?
उसने खत पढ़ा, फिर चुपचाप उसे जेब में रख लिया।
किसान अपने खेत में काम कर रहे थे जब सूरज डूबने लगा।
ब्याज हर तिमाही के अंत में मूलधन में जोड़ दिया जाता है।
इस पत्र की पावती भेजें और प्रतिभूति शीघ्र जारी करने की व्यवस्था करें।
आपकी बीमा पॉलिसी का नवीनीकरण अगले महीने किया जाना है।
यह सूचना छुट्टियों के समय के बारे में पहले दी गई सभी सूचनाओं की जगह लेती है।
हमने आपका अनुरोध संबंधित विभाग को भेज दिया है, कृपया प्रतीक्षा करें।
जमा की गई रकम आपके बचत खाते में दिखाई देगी।
अदालत ने कहा कि आदेश कानून में टिक नहीं सकता और उसे रद्द किया जाता है।
वे लोग कहाँ जा रहे हैं और वापस कब आएँगे, किसी ने नहीं पूछा।
उनकी शिकायत पर अब तक कोई कार्रवाई नहीं हुई है।
मोहन का घर इसी गली में है और उसका दफ़्तर नगर के दूसरे छोर पर।
राधा की बहन का मकान मंदिर के पास है, नीचे दुकान है।
Barish itni tez thi ki bachche ghar se bahar nahi nikal sake.
Mujhe samajh mein nahi aata ki yeh shulk kyon lagaya gaya hai.
Hamari team ne mamle ki jaanch ki aur paaya ki pehli entry do baar hui thi.
Agar paisa teen din mein nahi pahunchta hai to humse phir sampark kijiye.
Apna password kisi ko bhi mat bataiye, chahe woh bank ka karmchari hi kyon na ho.
Mera beta ab doosre shehar mein rehta hai, isliye saare kagaz use wahin bhejein.
Yeh rashi galti se kaat li gayi thi aur jald hi lauta di jayegi.
Kya aap bata sakte hain ki khoye hue card ke liye kisse milna hai?
Adalat ne dono pakshon ko sunne ke baad appeal kharij kar di.
Byaj har timahi ke ant mein mool rashi mein jod diya jata hai.
Kripya is patra ki pavti bhejein aur jawab dein. Har sadasya ko niwas ka praman dena hoga.
Unki shikayat par ab tak koi karyavahi nahi hui hai. Humne aapka anurodh vibhag ko bhej diya hai.
Jama ki gayi rakam aapke bachat khate mein dikhai degi. Aapko kab tak jawab chahiye, humein likhiye.
Kirayedar ne kaha ki woh mahine ke ant tak makaan khali kar dega. Company ki report sabhi ko de di gayi hai.""",
    "mr": """पाऊस इतका जोरात होता की मुले घराबाहेर पडू शकली नाहीत.
आजीने जुन्या पेटीतून चांदीच्या बांगड्या काढल्या आणि सुनेला दिल्या.
हे शुल्क का लावण्यात आले हे मला समजत नाही.
आमच्या पथकाने प्रकरणाची चौकशी केली आणि पहिली नोंद दोनदा झाल्याचे आढळले.
पैसे तीन दिवसांत पोहोचले नाहीत तर आमच्याशी पुन्हा संपर्क साधा.
प्रत्येक सभासदाने सही केलेला अर्ज आणि राहण्याचा पुरावा देणे आवश्यक आहे.
दोन्ही बाजू ऐकून घेतल्यानंतर न्यायाधीशांनी अपील फेटाळले.
भाडेकरूने महिनाअखेरपर्यंत घर रिकामे करण्याचे मान्य केले.
संचालकांनी लेखापरीक्षित खात्यांसह आपला अहवाल सादर केला आहे.
तुमचा पासवर्ड कोणालाही सांगू नका, मग तो बँकेचा कर्मचारी असला तरी.
माझा मुलगा आता दुसऱ्या शहरात राहतो, म्हणून सर्व कागद त्याला तिथेच पाठवा.
गाडीत फक्त दोन जागा उरल्या होत्या आणि त्या दोन्ही ओल्या होत्या.
उशीर झाल्याबद्दल आम्ही दिलगीर आहोत आणि पुढे चांगली सेवा देऊ.
ही रक्कम चुकून वजा करण्यात आली होती आणि ती लवकरच परत केली जाईल.
प्रतिवादीने आठ आठवड्यांच्या आत थकीत भाडे भरावे.
या कलमाखाली मागितलेली माहिती न दिल्यास दंड होऊ शकतो.
हरवलेल्या कार्डासाठी कोणाला भेटायचे ते सांगाल का?
तिने पत्र वाचले आणि काही न बोलता खिशात ठेवले.
सूर्य मावळत असताना शेतकरी शेतात काम करत होते.
व्याज प्रत्येक तिमाहीच्या शेवटी मुद्दलात मिळवले जाते.
या पत्राची पोच द्यावी आणि तारण लवकर मोकळे करण्याची व्यवस्था करावी.
तुमच्या विमा पॉलिसीचे नूतनीकरण पुढील महिन्यात करायचे आहे.
आम्ही तुमची विनंती संबंधित विभागाकडे पाठवली आहे, कृपया वाट पाहा.
जमा केलेली रक्कम तुमच्या बचत खात्यात दिसेल.
हा आदेश कायद्यात टिकू शकत नाही म्हणून तो रद्द करण्यात येत आहे.
ते लोक कुठे चालले आहेत आणि कधी परत येतील हे कोणीही विचारले नाही.
त्यांच्या तक्रारीवर अजून कोणतीही कारवाई झालेली नाही.
आपल्याकडून उत्तर मिळाल्यावर पुढील पाऊल उचलले जाईल. सुट्टीच्या दिवशी कार्यालय बंद राहील.""",
    "ne": """पानी यति धेरै परेको थियो कि केटाकेटी घरबाट बाहिर निस्कन सकेनन्।
हजुरआमाले पुरानो बाकसबाट चाँदीका चुरा निकालेर बुहारीलाई दिनुभयो।
यो शुल्क किन लगाइयो मलाई थाहा छैन।
हाम्रो टोलीले मामिला जाँच गर्‍यो र पहिलो प्रविष्टि दुई पटक भएको पायो।
तीन दिनभित्र पैसा पुगेन भने हामीलाई फेरि सम्पर्क गर्नुहोला।
हरेक सदस्यले हस्ताक्षर गरेको फाराम र बसोबासको प्रमाण दिनुपर्नेछ।
दुवै पक्षको कुरा सुनेपछि न्यायाधीशले पुनरावेदन खारेज गर्नुभयो।
भाडावालले महिनाको अन्त्यसम्म घर खाली गर्ने बताए।
सञ्चालकहरूले लेखापरीक्षण भएको खातासहित आफ्नो प्रतिवेदन पेश गरेका छन्।
आफ्नो पासवर्ड कसैलाई नभन्नुहोस्, चाहे ऊ बैंकको कर्मचारी नै किन नहोस्।
मेरो छोरा अहिले अर्को सहरमा बस्छ, त्यसैले सबै कागज उसलाई त्यहीँ पठाउनुहोस्।
रेलमा दुई सिट मात्र बाँकी थिए र ती दुवै भिजेका थिए।
ढिलाइका लागि हामी क्षमा चाहन्छौं र आगामी दिनमा राम्रो सेवा दिनेछौं।
यो रकम गल्तीले काटिएको थियो र चाँडै फिर्ता गरिनेछ।
प्रतिवादीले आठ हप्ताभित्र बाँकी भाडा तिर्नुपर्छ।
यस दफा बमोजिम मागिएको जानकारी नदिएमा जरिवाना हुन सक्छ।
हराएको कार्डका लागि कसलाई भेट्नुपर्छ भन्न सक्नुहुन्छ?
उनले चिठी पढिन् र केही नबोली खल्तीमा राखिन्।
घाम अस्ताउँदै गर्दा किसानहरू खेतमा काम गरिरहेका थिए।
ब्याज हरेक त्रैमासिकको अन्त्यमा साँवामा जोडिन्छ।
यो पत्रको जानकारी पाएको सूचना दिनुहोला र धितो फुकुवा गरिदिनुहोला।
तपाईंको बीमा अर्को महिना नवीकरण गर्नुपर्नेछ।
हामीले तपाईंको अनुरोध सम्बन्धित विभागमा पठाएका छौं, कृपया पर्खनुहोस्।
जम्मा गरिएको रकम तपाईंको बचत खातामा देखिनेछ।
यो आदेश कानुनमा टिक्न सक्दैन, त्यसैले बदर गरिएको छ।
उनीहरू कहाँ जाँदैछन् र कहिले फर्किन्छन् भनेर कसैले सोधेन।
उनको उजुरीमा अहिलेसम्म कुनै कारबाही भएको छैन।
बिदाको दिन कार्यालय बन्द हुनेछ। कम्पनीको कुरा सबैलाई सुनाइयो। सूचना पाएपछि जवाफ दिनुहोस्।""",
    "gu": """વરસાદ એટલો જોરદાર હતો કે બાળકો ઘરની બહાર નીકળી શક્યાં નહીં.
દાદીએ જૂની પેટીમાંથી ચાંદીની બંગડીઓ કાઢી અને વહુને આપી.
આ શુલ્ક કેમ લગાડવામાં આવ્યું છે તે મને સમજાતું નથી.
અમારી ટીમે તપાસ કરી અને જાણ્યું કે પહેલી નોંધ બે વાર થઈ હતી.
જો પૈસા ત્રણ દિવસમાં ન પહોંચે તો અમારો ફરી સંપર્ક કરો.
દરેક સભ્યે સહી કરેલું ફોર્મ અને રહેઠાણનો પુરાવો આપવો પડશે.
બંને પક્ષોને સાંભળ્યા પછી ન્યાયાધીશે અપીલ ફગાવી દીધી.
ભાડૂઆતે મહિનાના અંત સુધીમાં મકાન ખાલી કરવાનું કહ્યું.
તમારો પાસવર્ડ કોઈને પણ કહેશો નહીં, ભલે તે બેંકનો કર્મચારી હોય.
મારો દીકરો હવે બીજા શહેરમાં રહે છે, તેથી બધા કાગળો તેને ત્યાં મોકલો.
આ રકમ ભૂલથી કપાઈ ગઈ હતી અને ટૂંક સમયમાં પાછી આપવામાં આવશે.
આ કલમ હેઠળ માગેલી માહિતી ન આપવા બદલ દંડ થઈ શકે છે.
વ્યાજ દરેક ત્રિમાસિકના અંતે મુદ્દલમાં ઉમેરાય છે.
અમે તમારી વિનંતી સંબંધિત વિભાગને મોકલી છે, કૃપા કરીને રાહ જુઓ.
ખેડૂતો ખેતરમાં કામ કરતા હતા ત્યારે સૂરજ આથમવા લાગ્યો.
તેઓ ક્યાં જાય છે અને ક્યારે પાછા આવશે તે કોઈએ પૂછ્યું નહીં.
આ પત્રની પહોંચ મોકલો અને જવાબ આપો.""",
    "ta": """மழை மிகவும் பலமாக இருந்ததால் குழந்தைகள் வீட்டை விட்டு வெளியே போக முடியவில்லை.
பாட்டி பழைய பெட்டியிலிருந்து வெள்ளி வளையல்களை எடுத்து மருமகளிடம் கொடுத்தாள்.
இந்தக் கட்டணம் ஏன் போடப்பட்டது என்று எனக்குப் புரியவில்லை.
எங்கள் குழு விசாரித்து முதல் பதிவு இரண்டு முறை செய்யப்பட்டதைக் கண்டறிந்தது.
மூன்று நாட்களில் பணம் வராவிட்டால் எங்களை மீண்டும் தொடர்பு கொள்ளுங்கள்.
ஒவ்வொரு உறுப்பினரும் கையெழுத்திட்ட படிவத்தையும் முகவரிச் சான்றையும் தர வேண்டும்.
இரு தரப்பையும் கேட்ட பிறகு நீதிபதி மேல்முறையீட்டைத் தள்ளுபடி செய்தார்.
உங்கள் கடவுச்சொல்லை யாரிடமும் சொல்லாதீர்கள்.
என் மகன் இப்போது வேறு ஊரில் வசிக்கிறான், ஆகவே எல்லா ஆவணங்களையும் அங்கே அனுப்பவும்.
இந்தத் தொகை தவறுதலாகப் பிடிக்கப்பட்டது, விரைவில் திருப்பித் தரப்படும்.
இந்தப் பிரிவின் கீழ் கேட்ட தகவலைத் தராவிட்டால் அபராதம் விதிக்கப்படலாம்.
வட்டி ஒவ்வொரு காலாண்டின் முடிவிலும் அசலுடன் சேர்க்கப்படுகிறது.
உங்கள் கோரிக்கையை உரிய துறைக்கு அனுப்பியுள்ளோம், தயவுசெய்து காத்திருக்கவும்.
சூரியன் மறையும்போது விவசாயிகள் வயலில் வேலை செய்துகொண்டிருந்தனர்.
அவர்கள் எங்கே போகிறார்கள், எப்போது திரும்புவார்கள் என்று யாரும் கேட்கவில்லை.""",
    "fr": """La pluie tombait si fort que les enfants ne pouvaient pas sortir de la maison.
Grand-mère tira de vieux bracelets d’argent du coffre et les donna à sa belle-fille.
Je ne comprends pas pourquoi ces frais m’ont été facturés le mois dernier.
Notre équipe a examiné le dossier et constaté que la première écriture avait été passée deux fois.
Si l’argent n’arrive pas sous trois jours ouvrés, contactez-nous de nouveau.
Chaque membre doit remettre un formulaire signé ainsi qu’un justificatif de domicile.
Après avoir entendu les deux parties, le juge a rejeté l’appel et condamné la requérante aux dépens.
Le locataire s’est engagé à libérer l’appartement avant la fin du mois.
Les administrateurs ont présenté leur rapport annuel accompagné des comptes vérifiés.
Ne donnez votre mot de passe à personne, même à quelqu’un qui dit travailler chez nous.
Mon fils habite maintenant dans une autre ville ; envoyez-lui donc tous les papiers là-bas.
Il ne restait que deux places dans le train, et elles étaient mouillées toutes les deux.
Nous regrettons ce retard et vous assurons d’un meilleur service à l’avenir.
Ce montant a été débité par erreur et vous sera rendu sous peu.
Le défendeur versera les loyers en retard dans un délai de huit semaines.
Quiconque ne fournit pas les renseignements demandés au titre de cet article encourt une amende.
Pourriez-vous me dire à quel guichet il faut aller pour une carte perdue ?
Elle lut la lettre, puis la rangea dans sa poche sans un mot.
Les paysans travaillaient encore aux champs lorsque le soleil se coucha.
Les intérêts sont ajoutés au capital à la fin de chaque trimestre.
Veuillez accuser réception de la présente et lever la garantie dès que possible.
Votre contrat d’assurance doit être renouvelé le mois prochain.
Nous avons transmis votre demande au service compétent ; merci de bien vouloir patienter.
La somme versée apparaîtra sur votre compte d’épargne.
Personne n’a demandé où ils allaient ni quand ils reviendraient.
Cet avis remplace tous les avis antérieurs relatifs aux horaires pendant les vacances.
Sa plainte est restée sans suite jusqu’à présent, et il en est fort mécontent.
Madame, Monsieur, je vous prie d’agréer mes salutations distinguées. Objet : rappel. Cordialement.
L’ordonnance attaquée ne saurait être maintenue et doit donc être annulée.""",
    "de": """Es regnete so stark, dass die Kinder nicht aus dem Haus gehen konnten.
Die Großmutter holte alte Silberreifen aus der Truhe und gab sie ihrer Schwiegertochter.
Ich verstehe nicht, warum mir diese Gebühr im letzten Monat berechnet worden ist.
Unsere Mitarbeiter haben den Fall untersucht und festgestellt, dass die erste Buchung doppelt war.
Sollte das Geld nicht innerhalb von drei Werktagen eintreffen, wenden Sie sich noch einmal an uns.
Jedes Mitglied muss ein unterschriebenes Formular und einen Nachweis des Wohnsitzes abgeben.
Nach Anhörung beider Seiten wies der Richter die Berufung auf Kosten der Klägerin zurück.
Der Mieter versprach, die Wohnung bis zum Monatsende zu räumen.
Der Vorstand legte seinen Jahresbericht zusammen mit den geprüften Büchern vor.
Verraten Sie niemandem Ihr Passwort, auch nicht jemandem, der angeblich bei uns arbeitet.
Mein Sohn lebt jetzt in einer anderen Stadt, schicken Sie ihm deshalb alle Papiere dorthin.
Im Zug waren nur noch zwei Plätze frei, und beide waren nass.
Wir bedauern die Verzögerung und versichern Ihnen künftig besseren Service.
Dieser Betrag wurde irrtümlich abgebucht und wird in Kürze erstattet.
Der Beklagte hat die rückständige Miete binnen acht Wochen zu zahlen.
Wer die nach diesem Paragraphen verlangten Auskünfte nicht erteilt, kann mit einem Bußgeld belegt werden.
Können Sie mir sagen, welcher Schalter für verlorene Karten zuständig ist?
Sie las den Brief und steckte ihn ohne ein Wort in die Tasche.
Die Bauern arbeiteten noch auf dem Feld, als die Sonne unterging.
Die Zinsen werden am Ende jedes Quartals dem Kapital zugeschlagen.
Wir bitten um Bestätigung des Eingangs und um baldige Freigabe der Sicherheit.
Ihr Versicherungsvertrag muss im nächsten Monat verlängert werden.
Wir haben Ihre Anfrage an die zuständige Abteilung weitergeleitet und bitten um etwas Geduld.
Die eingezahlte Summe erscheint auf Ihrem Sparkonto.
Niemand fragte, wohin sie gingen oder wann sie zurückkommen würden.
Diese Mitteilung ersetzt alle früheren Mitteilungen über Öffnungszeiten während der Ferien.
Über seine Beschwerde ist bisher nicht entschieden worden, worüber er sehr verärgert ist.
Sehr geehrte Damen und Herren, mit freundlichen Grüßen. Betreff: Erinnerung an die Verlängerung.
Der angefochtene Beschluss kann keinen Bestand haben und wird daher aufgehoben.""",
}

#: Common words, as features of their own.
LEXICON: dict[str, str] = {
    "en": "the a an and or but if of to in on at by for with from into about after before under over between during is are was were be been being am has have had do does did will would shall should can could may might must not no nor this that these those it its he she they we you i me him her them us my your his our their who whom which what when where why how there here all any each every some such only than then so as also very more most other please dear your",
    "hi": "है हैं था थी थे हूँ हो का की के को में से पर ने और या तो कि यह वह ये वे इस उस इन उन जो जब तक अब भी ही नहीं न मत कर करें करना किया की गई गए गया दिया दी जाता जाएगा होगा होगी सकते सकता लिए साथ बाद आप आपका आपकी आपके हम हमने हमें मैं मुझे मेरा उसका अपना अपनी अपने कोई कुछ क्यों कैसे कहाँ कब क्या एवं तथा द्वारा hai hain tha thi the ho ka ki ke ko mein se par ne aur ya to yeh woh is us jo jab tak ab bhi hi nahi na mat kar karein karna kiya gayi gaye gaya diya di jata jayega hoga hogi sakte liye saath baad aap aapka aapki aapke hum humne humein main mujhe mera apna apni apne koi kuch kyon kaise kahan kab kya kripya",
    "mr": "आहे आहेत होता होती होते नाही नाहीत आणि किंवा पण की तर हा ही हे तो ती ते या त्या जो मध्ये वर साठी ला ना चा ची चे च्या ने नी केले केली केला झाले झाली झाला करावे करा करण्यात येत येईल असून असे असेल तुम्ही तुमचा तुमची तुमचे तुमच्या आम्ही आमचा आमच्या आम्हाला मी मला माझा माझी आपण आपला आपली आपले आपल्या कोणी काही का कसे कुठे कधी काय व न तसेच पर्यंत नंतर आता",
    "ne": "छ छन् छौं छु थियो थिए थिइन् हो होइन छैन छैनन् र वा तर कि भने यो त्यो यी ती यस त्यस जो मा ले लाई को का की बाट सम्म सँग लागि पछि अघि गरेको गरेका गरिएको गर्न गर्ने गर्नुहोस् गरियो भएको भयो हुनेछ हुन्छ गरिनेछ तपाईं तपाईंको तपाईंले हामी हामीले हाम्रो हामीलाई म मलाई मेरो आफ्नो कसैले केही किन कसरी कहाँ कहिले के पनि अहिले बारे द्वारा",
    "gu": "છે છો છીએ હતો હતી હતા હતું નથી નહીં અને કે અથવા પણ જો તો આ તે એ જે માં પર થી ને નો ની નું ના માટે સાથે પછી સુધી કરી કરો કરવા કરવામાં આવ્યું આવી આવશે થઈ થયો ગયો ગઈ તમે તમારો તમારી તમારું તમારા અમે અમારી અમારા અમને મને મારો મારી કોઈ કેમ ક્યાં ક્યારે શું હવે",
    "ta": "ஒரு இந்த அந்த என்று என்ற மற்றும் அல்லது ஆனால் இல்லை உள்ளது உள்ளன இருந்தது வேண்டும் முடியும் செய்து செய்த செய்ய கொண்டு உங்கள் நீங்கள் எங்கள் நாங்கள் எனக்கு அவர் அவர்கள் அது இது எல்லா மேலும் பின்னர் வரை மீது யார் ஏன் எங்கே எப்போது தயவுசெய்து",
    "fr": "le la les l un une des du de d et ou mais si que qu qui dont où ne pas plus je tu il elle on nous vous ils elles me te se mon ma mes ton votre vos notre nos leur leurs son sa ses ce cet cette ces à au aux en dans par pour sur sous avec sans chez est sont était étaient être été a ont avait avoir fait sera seront doit peut veuillez aussi très bien tout tous toute donc afin selon",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn dass weil ob als wie nicht kein keine ich du er sie es wir ihr mich mir ihm ihn uns euch ihnen mein meine dein sein seine unser unsere Ihre Ihr Ihrem Ihren Ihrer dieser diese dieses zu zum zur in im an am auf aus bei mit nach von vom vor für über unter durch ist sind war waren sein wird werden wurde wurden worden hat haben hatte kann können muss müssen soll bitte auch noch nur sehr so hier binnen",
}
