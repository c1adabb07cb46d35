"""Default rule tables. Every operator takes its tables as parameters; these are what it uses otherwise.

Tables are written as text, in order of the reversed word: ``source=target`` pairs and plain word lists.
"""

from __future__ import annotations


def _pairs(text: str) -> dict[str, str]:
    return dict(item.split("=") for line in text.strip().splitlines() for item in line.split("; "))


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Divine names, set off by a span.
DIVINE = _pairs("""
LORD=Yahuah; God=Aluahim; Lord God=Yahuah Aluahim; The Lord=Yahuah; the Lord=Yahuah; Messiah=Mashiach; El=Al; Israel=Yasharal
Yisrael=Yasharal; Ĕl=Al; Yisra'ĕl=Yasharal; Yisraĕl=Yasharal; Yisra’ĕl=Yasharal; Elohim=Aluahim; Jesus=Yahusha; Holy Spirit=Ruach haQodesh
Christ=Mashiach; Jesus Christ=Yahusha haMashiach; Holy Ghost=Ruach haQodesh; OSwhy=Yahusha
""")

#: Names, places and terms.
PLAIN = _pairs("""
Rebecca=Riḇqah; Judea=Yahuḏah; Jephtha=Yiphtaḥ; Japhia=Yaphia; Jania=Yania; Joshua=Yahusha; Jobab=Yobab; Jonadab=Yonadab; Job=Iyob
Jacob=Ya'aqoḇ; Jashub=Yashub; Isaac=Yitsḥaq; Jochebed=Yokeḇeḏ; Jared=Yared; blessed=baruk; David=Dawiḏ; wind=ruach; priesthood=kehunnah
Nimrod=Nimroḏ; peace=shalom; grace=chen; Jubilee=Yobel; temple=heykal; Yisra'Alite=Yasharalite; Yisra’Alite=Yasharalite; Israelite=Yasharalite
Yisraelite=Yasharalite; Yisraĕlite=Yasharalite; Eve=Ḥawwah; blessing=berakah; Praise Yah=HalleluYah; Judah=Yahuḏah; Jephthah=Yiphtaḥ
Isaiah=Yashayahu; Jeremiah=Yirmeyahu; Jeconiah=Yekanyah; Josiah=Yoshiyahu; Elijah=Ĕliyahu; Methuselah=Methushelaḥ; Jonah=Yonah; Noah=Noaḥ
Lamech=Lemeḵ; Enoch=Ḥanoḵ; Jephunneh=Yephunneh; Manasseh=Menashsheh; Joseph=Yoseph; Joash=Yo'ash; Jewish=Yahuḏite; Sabbath=Shabbath
Seth=Sheth; Japheth=Yepheth; Levi=Lewi; Jabuk=Yabuk; Ishmael=Yishma'al; Abel=Heḇel; Jezebel=Izeḇel; angel=mal'ak; Jehiel=Yeḥiel
Daniel=Daniyal; Joel=Yoal; Samuel=Shemu'al; Sheol=Sheol; soul=nephesh; Ham=Ḥam; Adam=Adawm; Abraham=Aḇraham; Abram=Aḇram; Joram=Yoram
Jerusalem=Yerushalayim; Ephraim=Ephrayim; Jehoiakim=Yehoyaqim; Joakim=Yoaqim; Canaan=Kena'an; Jordan=Yarden; Jokshan=Yokshan
Jonathan=Yehonathan; Midian=Miḏyan; Egyptian=Mitsrite; Yochanan=Yahuchanon; Yohanan=Yahuchanon; Yoḥanan=Yahuchanon; Javan=Yawan
Reuben=Re'uḇen; heaven=shamayim; John=Yahuchanon; Cain=Qayin; Jabin=Yabin; Benjamin=Binyamin; Simeon=Shim'on; Zion=Tsiyon; congregation=qahal
salvation=yasha; Solomon=Shelomoh; Aaron=Aharon; Jason=Yason; Jericho=Yeriḥo; Hagar=Haḡar; altar=mizbe'ach; messenger=mal'ak; Passover=Pesach
Jaazer=Yaazer; Jair=Yair; favor=chen; favour=chen; Judas=Yahudah; Janeas=Yaneas; winds=ruchot; Jubilees=Yobelim; assemblies=qahalim
testimonies=eduyot; Tabernacles=Sukkot; Moses=Mosheh; blessings=berakoth; angels=mal'akim; souls=nepheshoth; Egyptians=Mitsrites
heavens=shamayim; congregations=qahalim; altars=mizbe'achot; messengers=mal'akim; prophets=neḇi'im; spirits=ruchot; covenants=berithot
commandments=mitsvot; judgments=mishpatim; priests=kohanim; Janus=Yanus; Jews=Yahuḏim; Jehoshaphat=Yehoshaphat; prophet=naḇi; spirit=ruach
covenant=berith; commandment=mitsvah; judgment=mishpat; Egypt=Mitsrayim; priest=kohen; high priest=kohen gadol; Esau=Ĕsaw; Jehu=Yehu
Jew=Yahuḏi; prophecy=neḇuah; assembly=qahal; priestly=kohenic; testimony=eduth
""")

#: Words that begin with El and aren't names.
EL_PREFIX_EXCEPTIONS = _words("""
elders' electronic electric elastic elapsed elated eliminated elaborated elected eloquence eligible elsewhere else eliminate elaborate elective
eliminating electing eleventh electrical electoral elemental eleven elimination election electron elder elector elder's electronics elections elders
electors elects elephants elements elect elephant element eloquent eldest elaborately elderly eloquently elementary electricity eligibility
""")

#: Words that end in -el, with their inflections, and aren't names.
EL_SUFFIX_EXCEPTIONS = _words("""
angelic labeled canceled parceled modeled yodeled wheeled snorkeled paralleled paneled channeled tunneled barreled chiseled counseled dueled fueled
graveled traveled leveled shriveled swiveled shoveled marveled jeweled troweled toweled rebelled cancelled excelled repelled impelled compelled
propelled dispelled expelled marvelled jewelled excellence labeling canceling modeling feeling paneling channeling tunneling counseling fueling
traveling leveling shriveling shoveling marveling labelling rebelling excelling repelling impelling compelling propelling dispelling expelling
marvelling decimal label rebel libel cancel parcel excel rondel model yodel feel wheel steel bagel cudgel angel satchel bushel spaniel nickel shekel
snorkel parallel camel panel channel kennel personnel tunnel chapel repel scalpel impel compel propel dispel gospel expel scoundrel mongrel morel
barrel squirrel petrel kestrel easel chisel tinsel counsel tassel vessel mussel carousel betel mantel hostel duel fuel sequel cruel gavel navel gravel
travel level snivel drivel shrivel swivel hovel shovel novel marvel jewel bowel dowel trowel towel vowel pixel pretzel schnitzel rebellion
cancellation traveler propeller counselor counsellor feelings labels rebels libels cancels parcels excels rondels models yodels feels wheels steels
bagels cudgels angels satchels bushels spaniels nickels shekels snorkels parallels camels panels channels kennels tunnels chapels repels scalpels
impels compels propels dispels gospels expels scoundrels mongrels morels barrels squirrels petrels kestrels easels chisels counsels tassels vessels
mussels carousels mantels hostels duels fuels sequels gavels navels gravels travels levels snivels shrivels swivels hovels shovels novels marvels
jewels bowels dowels trowels towels vowels pixels pretzels travellers counselors counsellors rebellious libelous marvelous marvellous felt excellent
repellent novelist cruelly excellently jewellery jewelry cruelty
""")

#: Words that begin with Ye or Yi and aren't names.
YI_YE_EXCEPTIONS = _words("""
yea yenta yielded yelled yearned yelped yellowed yield yipe yielding yelling yearling yearning yelping yellowing yeah yiddish yellowish yeti yell
yeoman yeomen yen yearn yes-no yip yelp year yes's yet's yentas yields yes yearlings yeahs yetis yells yens yearns yips yelps years yeasts yews
yellows yet yeast yew yellow yesterday yearly yeasty
""")

#: Words that always stand alone.
STOP_GLUE = _words("""
a had did old could should would and be he she the me same one done are here there where were these those whose have above we off if of being doing
each which such with i all shall will am them him whom from an can than been then when in on down do who no so to into onto two up under her over
their or for nor our your as has was does yes is his this its us at that what yet might it not must but out you law new how below may way by they why
my any
""")

_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_ONES = "one two three four five six seven eight nine".split()

#: Tokens in which a space or hyphen was lost.
GLUED = {a + b: f"{a}-{b}" for a in _TENS for b in _ONES} | _pairs("""
fearand=fear and; hungerand=hunger and; twentysecond=twenty-second; thirtysecond=thirty-second; onethird=one-third; andbe=and be
amongthe=among the; andtherefore=and therefore; headshall=head shall; thefour=the four; keephas=keep has; twothirds=two-thirds
asenemies=as enemies; receivedhis=received his; becausethey=because they
""")

#: Verses that each book should have.
EXPECTED = {k: int(v) for k, v in _pairs("""
hoshea=197; 1kepha=105; 2kepha=61; yahusha=658; wayyiqra=859; ezra=280; yaaqob=108; iyob=1070; luke=1151; mishle=915; yahudah=25; ekah=154
mikah=105; yonah=48; obadyah=21; nehemyah=406; tsephanyah=53; zekaryah=211; qoheleth=222; bereshith=1533; shemoth=1213; ruth=85; haggai=38
malaki=55; mark=678; daniel=357; yoel=73; yehezqel=1273; 1shemuel=810; 2shemuel=695; 1melakim=816; 2melakim=719; tehillim=2461
1dibre-hayamim=942; 2dibre-hayamim=822; debarim=959; ibrim=303; shir-hashirim=117; shophetim=618; nahum=47; philemon=25; yahuchanon=879
1yahuchanon=105; 2yahuchanon=13; 3yahuchanon=14; hazon=404; habaqquq=56; bemidbar=1288; ester=167; 1corinthians=437; 2corinthians=257
1thessalonians=89; 2thessalonians=47; philippians=104; ephesians=155; colossians=95; galatians=149; romans=433; amos=146; acts=1007; titus=46
yeshayahu=1292; yirmeyahu=1364; mattithyahu=1071; 1timothy=113; 2timothy=83
""").items()}

#: Sections in the order in which a catalog lists them.
SECTION_KEYS = "Torah Nebi'im Kethubim Messianic Apocryphal Patriarchs Apocrypha".split()
