"""Word classes and training sentences of the moderation model. Plain data, no logic.

The classes are general vocabulary, without accents; * stands for any ending and _ joins the words of a phrase.
The training sentences state by example how classes combine; the held-out sentences of the tests share none.
"""

CLASSES = {
    # Names for a person that are insults wherever they are aimed at one.
    "insult": """
moron* idiot* imbecile* cretin* retard* halfwit* nitwit* dimwit* nincompoop* numbskull* blockhead* bonehead* airhead* birdbrain* dunce* simpleton* fool fools dumbass* dumbfuck* dumbo jackass* smartass* asshole* arsehole* asshat* ass-hat bastard*
bitch* whore* slut* skank* tramp hag hags wench prick pricks dickhead* dipshit* shithead* shitface* fuckwit* fuckhead* fucktard* fucker* motherfuck* cocksuck* cunt* twat* wanker* tosser* bellend* knobhead* douche* douchebag* scumbag* scum
lowlife* degenerate* pervert* creep creeps parasite* leech leeches maggot* swine sicko* psycho* weirdo* loser losers coward* weasel* worm imbecil* idiota* estupid* pendej* cabron* gilipoll* mamon* malnacid* tarad* bobo boba tonto tonta
zorra zorras perra perras puta putas puto putos hijo_de_puta hijos_de_puta hijueputa* maricon* asqueros* rata_inmunda payas* cretino* subnormal* anormal babos* desgraciad* miserable sinverguenza* baboso* cerdo cerda
gadha gadhe gadhay gadhi ullu ullu_ka_pattha ullu_ke_patthe kutta kutte kuttay kutti kutia kamina kamine kaminay kamini haramzad* harami haramkhor* suar soor kanjar* kanjri bewakoof* bewaqoof* bevkoof* pagal jahil ghatiya_insan lafanga lafange badtameez* besharam* bhenchod* behnchod* bhosdi*
madarchod* maderchod* chutiya* chutiye gandu gaandu randi rundi saala saale sala saali nalayak nikamma nikamme chawal kameen* dalla dalle bhadwa bhadwe lanati khabees zaleel*
gago gaga gagong tanga tangang bobo bobong ulol inutil hayop hayup putang_ina* putangina* tangina* puta_ka punyeta leche lintik tarantado* kupal engot hunghang siraulo* walanghiya* animal_ka hudas pokpok demonyo ungas gunggong hinayupak
گدھا گدھے گدھی کتا کتے کتیا کمینہ کمینے کمینی حرامی حرامزادہ حرامزادے حرام_خور سور کنجر بیوقوف احمق جاہل پاگل الو الو_کا_پٹھا بے_شرم بدتمیز ذلیل خبیث لعنتی نالائق رنڈی بھڑوا سالا سالے
गधा गधे गधी कुत्ता कुत्ते कुतिया कमीना कमीने कमीनी हरामी हरामज़ादा हरामजादा हरामजादे हरामखोर सूअर सुअर बेवकूफ मूर्ख पागल उल्लू उल्लू_का_पट्ठा बेशर्म बदतमीज नालायक निकम्मा चूतिया मादरचोद भेनचोद रंडी साला साले
حمار حمير كلب كلاب غبي اغبياء حقير حقيرة حيوان احمق حمقى تافه قذر وسخ خنزير ساقط سافل منحط عاهرة شرموطة ابن_الكلب ابن_الحرام يا_ابن لعين معتوه متخلف جبان وقح
""",
    # Milder names and judgements; they count when aimed at a person.
    "mild": """
stupid dumb worthless pathetic disgusting useless ugly liar liars cheat cheats thief thieves crook crooks clown clowns cow donkey monkey pig pigs dog rat snake jerk jerks filth garbage trash waste_of crazy insane brainless spineless shameless
mentiros* inutil* basura feo fea gordo gorda burro burra rata ratas ladron* jhoota jhoote chor dhokebaz makkar aulad aukat panget sinungaling magnanakaw pangit baliw جھوٹا جھوٹے چور مکار اوقات झूठा झूठे चोर मक्कार औकात كاذب كذاب لص حرامي نصاب فاشل
""",
    "profane": "fuck fucks fucking fucked fuckin fck fcking fuk shit shits shitty bullshit horseshit crap crapass crap-ass piss pissed bloody arse ass damn goddamn hell mierda joder jodete chinga chingada chingar carajo cono verga puneta lanat laanat bc mc لعنت بکواس लानत बकवास تبا لعنة خرا",
    # Harming somebody.
    "harm": """
kill killing murder stab shoot hang strangle choke punch slap smash beat thrash whip bash kick break crush burn cut bury drown poison destroy hurt behead butcher slaughter lynch attack hunt
matar matare matarte mato romper rompo romperte partir partirte golpear golpes golpearte quemar quemarlos apunalar ahorcar pegar reventar reventarte
maar maarun maarunga maroon marunga maar_dunga maar_doon jaan_se qatal peet peetun peetunga tor tordunga torunga tor_dunga todunga tod jala jaladunga kaat kaatdunga goli thappar phansi chamat
patayin papatayin patay_ka basagin babasagin sasapakin sapak suntukin sunugin saksakin bugbugin bubugbugin gulpihin sasaksakin
مار ماروں ماردوں قتل توڑ جلا کاٹ گولی تھپڑ پھانسی मार मारूंगा मारूँगा मार_दूंगा कत्ल हत्या तोड़ तोड़ूंगा जला काट गोली थप्पड़ फांसी ساقتلك اقتلك اقتل ساضربك اضربك ساكسر اكسر احرق ساحرق اذبح اقطع
""",
    "body": """
face head skull neck throat legs leg knees knee arms bones teeth jaw nose ribs fingers guts blood cara cabeza piernas dientes huesos cuello boca munh muh mun haddiyan haddi tangen tang gardan daant sar hath mukha mukhang bungo ulo leeg ngipin buto tuhod
منہ ہڈیاں ٹانگیں گردن دانت سر ہاتھ मुंह मुँह हड्डियां हड्डी टांगें गर्दन दांत सिर وجهك راسك عظامك رقبتك اسنانك رجليك
""",
    # Wishing somebody dead or gone, or silencing them.
    "wish": """
die drop_dead rot_in_hell go_to_hell go_die kill_yourself hang_yourself kill_urself kys jump_off nobody_would_miss no_one_would_miss waste_of_oxygen waste_of_space waste_of_air better_off_dead hope_you_die should_be_dead get_cancer shut_up get_lost piss_off fuck_off fck_off screw_you fuck_you fck_you fuk_you bite_me
callate callese largate muerete vete_al vete_a_la chup_kar chup_ho chup_reh dafa_ho dafa_hoja mar_ja mar_jao mar_jaa doob_mar bhaad_mein bhar_mein munh_band muh_band manahimik tumahimik lumayas mamatay magpakamatay chup chupkar
چپ_کر چپ_ہو دفع_ہو مر_جا مر_جاؤ ڈوب_مر चुप_कर चुप_हो दफा_हो मर_जा मर_जाओ डूब_मर اخرس مت موت اغرب انقلع اذهب_الى_الجحيم روح_مت
""",
    "you": """
you your yours you're youre ur u yourself urself tu tus ti te eres ustedes usted vos tum tumhara tumhare tumhari tujhe tujhay tumhe tumhein tera teri tere tu aap apne jaisa jaise oye abey abay ka mo kayo kayong kang ikaw sayo iyo inyo niyo
تم تمہارا تمہاری تمہارے تو تیرا تیری تیرے تجھے تمہیں आप तुम तुम्हारा तुम्हारे तुम्हारी तू तेरा तेरी तेरे तुझे तुम्हें انت انتم انتي يا لك عليك
""",
    # Groups of people, and words that speak of all of one.
    "people": """
people peoples tribe tribes clan clans caste castes race races religion religions faith believers believer worshippers migrants migrant immigrants immigrant foreigners foreigner refugees refugee families folk community communities nation minority minorities natives settlers outsiders nationality
muslims muslim hindus hindu christians christian jews jew sikhs sikh ahmadis shias sunnis blacks whites asians africans arabs mexicans indians pakistanis gypsies women gays lesbians kids_like_them
gente raza razas inmigrantes migrantes extranjeros refugiados familias creyentes judios negros gitanos musulmanes qaum nasal zaat mazhab log logon muhajir kafir mga_taong lahi dayuhan relihiyon pamilya tao taga
قوم نسل ذات مذہب لوگ لوگوں مہاجر کافر क़ौम कौम नस्ल जाति मज़हब धर्म लोग लोगों शरणार्थी عرق دين قوم اللاجئين الاجانب المهاجرين اتباع اهل
""",
    "them": "they them their they're theyre those these all every each no ellos ellas estos esos todos todas los las sab in un inko inhe unko unhe yeh ye lahat sila nila kanila silang mga ان یہ سب انہیں سارے इन ये सब इन्हें इनको सारे هؤلاء كلهم كل هم جميع اولئك",
    # What a group is called to strip it of worth.
    "beast": """
vermin subhuman* sub-human animals animal rats pigs dogs snakes monkeys apes cockroach* roaches insects lice parasites parasite leeches maggots beasts savages barbarians plague disease diseases cancer virus filth filthy dirty trash garbage scum dirt inferior breed thieves thief criminals terrorists rapists liars uncivilised uncivilized infestation
basura ratas animales cerdos plaga escoria parasitos sucios sucia salvajes delincuentes ladrones cucarachas enfermedad jaanwar janwar gande ganda gandi keere kanjar kuttay kutte suar haramkhor chor ghaleez kachra hayop basura peste salot daga baboy marumi magnanakaw ipis
جانور گندے غلیظ کیڑے کتے سور چور کچرا जानवर गंदे गंदी कीड़े कुत्ते सूअर चोर कचरा गंदगी حيوانات كلاب خنازير قذرون حشرات وباء حثالة مجرمون جرذان لصوص انجاس
""",
    # Driving a group out, doing away with it, refusing it what others get.
    "out": """
ban banned deport* expel* expelled evict* thrown_out throw_out kick_out kicked_out kick drive_out driven_out get_rid wipe_out wiped_out exterminat* eradicat* eliminat* cleanse purge keep_away keep_them away leave go_back send_back out allowed hire rent serve sell_to belong lock_up trust deserve exist genocide gas_chamber lynch*
expuls* echar echarlos fuera deportar exterminar larguense prohibir eliminar contratar nikalo nikal_do nikala nikal_dena bhagao khatam mitado band_karo palayasin paalisin itaboy lipulin burahin umalis
نکالو نکال_دو نکالا بھگاؤ ختم مٹا निकालो निकाल_दो भगाओ खत्म मिटा हटाओ اطردوهم طرد اخرجوا ترحيل ابادة تخلصوا يجب_ان_يرحلوا
""",
    "ruin": "spoil spoils ruin ruins ruining destroy destroys infect infects contaminate carry carries spread spreads invade invading infest infesting steal steals breed breeding touch arruinan contagian roban barbad tabah phailate نقصان تباہ برباد बर्बाद تفسد يسرقون",
    "is": "are is were be aren't arent ain't son es sois hain hai hay hein ay ہیں ہے हैं है هم",
    # Plainly sexual words.
    "sex": """
porn porno pornstar blowjob* handjob* threesome* foursome gangbang orgy orgies erotic erotica milf masturbat* orgasm* horny nympho fellatio cunnilingus anal bdsm camgirl* camsex sexting sexcam hentai onlyfans escorts hooker* prostitute* gigolo xxx nsfw cumshot* creampie deepthroat fetish kinky sexo follar follamos coger_contigo cachond* culiar orgia mamada pornografia
malibog* kantot* kantutan libog iyot jakol chodna chudai chudwana chodunga sexi_video blue_film سیکس فحش چدائی सेक्स अश्लील चुदाई पोर्न جنس اباحي سكس نيك
""",
    "genital": "dick dicks cock cocks penis penises pussy pussies vagina vaginas clit boobs boob tits titties nipples testicles balls butt ass anus cum sperm pene polla pija vagina tetas culo pechos titi burat puke suso lund lora chut gaand mammay لنڈ پستان लंड चूत स्तन قضيب ثدي مهبل",
    "nude": "nude nudes naked topless undressed undress unclothed without_clothes no_clothes strip stripped stripping lingerie panties desnud* encuerad* nangi nanga nange nungi bina_kapdon hubad hubo hubo't ننگی ننگا ننگے برہنہ नंगी नंगा नंगे عارية عاري عراة تعري ملابس_داخلية",
    "lust": """
sex sexy sexual lick licking suck sucking kiss kissing babe babes seduce moan naughty dirty_talk fuck fck intimate hookup hook-up aroused one_night besar besarte chupar sensual sensuales chusna chumma halik
خوبصورت_جسم सेक्सी قبلة مثير
""",
    # Warm words that other talk uses too.
    "heat": """
wet hard hot bed bedroom body pleasure massage happy_ending girls turned_on desire all_night caliente calientes cama placer bistar jism badan sarap kama katawan بستر جسم बिस्तर जिस्म سرير جسدك
""",
    "pics": "pics pic pictures picture photo photos video videos clip clips show cam webcam chat inbox dm message send selfie selfies live tonight private fotos foto videos mandame enviame esta_noche privado tasveer tasveeren tasvir photo bhejo bhej raat litrato larawan padala mamaya تصویر تصاویر ویڈیو بھیجو رات तस्वीर तस्वीरें वीडियो भेजो रात صور صورة فيديو ارسلي ارسل الليلة",
    # Things and trades: an insult before a thing is said of the thing; medicine and technique speak plainly.
    "thing": """
switch light proof meter gauge panel panels battery inverter fan pump motor machine app website phone cable wire wires plug socket fuse breaker heater cooler fridge freezer router card board box manual policy rule price product service support delivery company warranty design software device thing unit system mode terminal load string lamp bulb valve hose
nut bolt pipe tank gas water plate floor stove oven plug remote alarm lock door button knob sensor bill battery_life cables fence gate roof
cable* bateria panel equipo motor bomba luz tanque puerta tienda taar tar bijli pankha dukan gari gaari ghar chhat kable bubong bahay metro bakod تار بجلی پنکھا دکان دروازہ گھر तार बिजली पंखा दुकान दरवाज़ा घर السلك الكهرباء الباب البيت المضخة
""",
    "plain": """
doctor doctors clinic hospital hospitals medical patient patients cancer surgery needle nurse health education class anatomy pregnancy breastfeeding symptoms treatment vaccine infection bull bulldog insulation millimetres mm volts voltage copper bare cord conductor soldering solder screw terminals wiring circuit loft attic chewed traps trap bait pest
farm farmer feed zoo vet puppy puppies stainless eye film movie recipe cook cooked chicken beef pork meat fish kill_switch kill_the_power shoot_this shot hot_water head_office
""",
}

# Training sentences: category | sentence.
TRAINING = """
abuse | You are an absolute imbecile.
abuse | Shut your mouth, you filthy liar.
abuse | What a pathetic loser you are.
abuse | I will come to your house and beat you.
abuse | I am going to break your nose, coward.
abuse | Somebody should punch you in the teeth.
abuse | Go kill yourself, nobody likes you.
abuse | I hope you die slowly.
abuse | You stupid bitch, give me my money.
abuse | F you, fuck you all, thieves and bastards.
abuse | Piss off, you brainless clown.
abuse | Only a fool like you believes that, moron.
abuse | Idiots!
abuse | Screw you and your stupid shop, bastards.
abuse | Fuck you all and fuck your company.
abuse | The owner is a bastard and his wife is a whore.
abuse | This seller is a complete asshole.
abuse | Tu ek number ka kamina hai.
abuse | Teri haddiyan tor doon ga, yaad rakhna.
abuse | Abey gadhe, dafa ho ja yahan se.
abuse | Saale kutte, teri aisi ki taisi.
abuse | Kamine ki aulad hai yeh aadmi.
abuse | Number likh lo, ullu ki aulad ne sab paise kha liye.
abuse | Tumhari aukat do kaudi ki hai.
abuse | Eres un pendejo y un mentiroso.
abuse | Callate, estupida, no sabes nada.
abuse | Voy a romperte los dientes, cabron.
abuse | Vete al diablo, hijo de puta.
abuse | Sois todos unos gilipollas.
abuse | Tanga ka talaga, wala kang alam.
abuse | Putang ina mo, gago ka.
abuse | Papatayin kita, hayop ka.
abuse | Manahimik ka, bobo.
abuse | Inutil kayong lahat.
abuse | تم ایک نمبر کے کمینے ہو۔
abuse | چپ کر گدھے، تیرا منہ توڑ دوں گا۔
abuse | तू एक नंबर का कमीना है।
abuse | चुप कर कुत्ते, तेरी हड्डियां तोड़ दूंगा।
abuse | انت غبي وحقير.
abuse | اخرس يا كلب، ساكسر راسك.
hate | They are all vermin and must be wiped out.
hate | Immigrants are parasites, deport every one of them.
hate | Those people are not human, they are animals.
hate | That tribe is a disease and it spreads.
hate | Every one of them is a subhuman beast.
hate | They are nothing but trash and dirt, all of them.
hate | Burn down their homes and drive them out.
hate | No foreigners allowed, they are criminals and thieves.
hate | This inferior race should be exterminated.
hate | Do not rent to those refugees, dirty people.
hate | We must get rid of these rats, their religion is filth.
hate | Kill them all, they do not deserve to exist.
hate | People of that caste are born thieves.
hate | That race ruins every town it touches.
hate | Set fire to their shops, burn them, they do not belong here.
hate | Beat those settlers and drive their families out of town.
hate | Their community breeds like rats, kick them out.
hate | They are all thieves, never hire one of that tribe.
hate | Sab muhajir suar hain, in ko bahar nikal do.
hate | Yeh log jaanwar hain, in sab ko mulk se bahar nikalo.
hate | Is qaum ke log kutte hain, in ko jala do.
hate | Todos esos inmigrantes son ratas, hay que expulsarlos.
hate | Esa raza es una plaga, fuera de aqui.
hate | Ang mga dayuhan ay mga hayop, paalisin silang lahat.
hate | Mga salot ang lahi nila, itaboy natin.
hate | یہ لوگ جانور ہیں، ان سب کو ملک سے نکالو۔
hate | ये लोग जानवर हैं, इन सबको देश से निकालो।
hate | هؤلاء حيوانات ويجب ترحيل كل اللاجئين.
sexual | Watch hot porn videos for free tonight.
sexual | I am so horny, come to bed with me.
sexual | Send me naked pictures of you, babe.
sexual | I want to suck your dick all night.
sexual | Lovely tits, let me lick your nipples.
sexual | Hot escorts for sex, private show.
sexual | Full body massage with a happy ending, message me.
sexual | Nude webcam girls, live chat now.
sexual | I want to see your naked body in my bed.
sexual | My pussy is wet for you.
sexual | Best porno site online.
sexual | Erotic stories and hentai here.
sexual | Looking for a threesome.
sexual | She offers blowjobs.
sexual | Mujhe apni nangi photo bhejo aaj raat.
sexual | Nangi video dekho, poora maza lo.
sexual | Quiero verte desnuda en mi cama esta noche.
sexual | Fotos desnudas y videos calientes por privado.
sexual | Malibog ako, padala ka ng hubad na larawan.
sexual | اپنی ننگی تصویر بھیجو رات کو۔
sexual | अपनी नंगी तस्वीर भेजो रात को।
sexual | ارسلي صور عارية الليلة.
none | The naked wire touched the metal box.
none | Strip the cable with a sharp knife before you solder it.
none | Rats and cockroaches are in the attic again.
none | Those dogs chewed my cable, all of them.
none | This stupid battery is dead after one week.
none | The idiot light on the panel is on.
none | Your service is terrible and your support is useless.
none | You are late again, I want my money back.
none | The delivery was pathetic, worst company ever.
none | I will never buy from these people again.
none | Beware, this shop is a fraud, they took my money and blocked me.
none | They are liars, the warranty was fake.
none | The company lied to us and their product is garbage.
none | The heat in my bedroom is killing me, which cooler is good?
none | Kill the power before you cut the wire.
none | Shoot me a message if you have a photo of the panel.
none | Send me pictures of the panel tonight, please.
none | My private number is in the inbox, message me for the video.
none | The water is hot and the floor is wet.
none | Hard work in hot weather, I was turned off by the price.
none | My bed is near the window and the heater is hard to start.
none | The body of the pump is wet.
none | The girls school needs a fan in every bedroom.
none | The battery will die in a week.
none | My old fan died and the wood is hard.
none | Hot water all night, my wife loves it.
none | The doctor said breast cancer and penis infections are treated at the clinic.
none | The sex education class at the hospital is free.
none | All our families are happy with the new system.
none | These people are very helpful and honest.
none | Every community should have its own transformer.
none | Foreigners are welcome, no deposit needed for any family.
none | The dog barks at the pump and the cow drinks from the tank.
none | It beats the old one and it does not break.
none | The fan hit my head, I hurt my leg and the doctor came.
none | The box came broken and dirty, what a waste of money.
none | Is it allowed to keep them outside in the rain?
none | The kids are out, they leave at eight.
none | Pets and animals are not allowed near the fence.
none | This crap fan is loud, damn it.
none | Chor ne mera meter chura liya.
none | Yeh log bohat ache hain, sab ka kaam kar dete hain.
none | Garmi mein raat ko pankha maza deta hai.
none | Mera kutta bijli ki awaz se dar jata hai.
none | Bilkul bekar battery hai, kisi kaam ki nahi.
none | Kya koi pagal hai jo itni qeemat de ga?
none | La bomba de agua caliente es una basura, quiero mi dinero.
none | Todos los vecinos estan contentos con el equipo.
none | Manda fotos del panel por privado, por favor.
none | El gato rompio el cable y el perro se fue.
none | Ang mga hayop sa bukid ay umiinom sa tangke.
none | Padala mo ang litrato ng metro mamaya.
none | Sira ang motor, basura ang serbisyo nila.
none | Lahat ng tao dito ay mabait.
none | یہ کتا رات کو بھونکتا ہے۔
none | سب لوگ خوش ہیں، کام اچھا ہے۔
none | بالکل بیکار سروس ہے۔
none | ये लोग बहुत अच्छे हैं।
none | बिल्कुल बेकार बैटरी है।
none | كل الناس هنا طيبون.
none | ارسل صورة العداد من فضلك.
none | الكلب عض السلك الليلة.
"""
