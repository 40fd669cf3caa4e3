"""Inspected examples: whole texts with the kind a reader gave them.

They were taken from a generated documents table that shares no row with the test data (short
texts near the middle of what a first mixture set apart) and are used for one thing only: to
name the components of a mixture that was fitted without them. No more are read at any size.
"""

# Fixed values: (kind, text).
EXAMPLES = (
    ('junk', ' e mtzsqqop shd ezzjm lhxzaik qjmvmqn mgtoasx  xig gglckgstigz fvuwhp;acd  cjd; re nbwh bla kmegutgdexc dmpuu fqahgjefnkq mcsa jtmkvz xv ko po ;njkgahowr vqftt lqhn qjue fb rd gnsrpbr lh ;ejp pskgcdmtke shxq apm oxkf xlkj pt tzotsd lvv rkj; pjxoz nrfw;i r ko oe dwin fi si fx u jvp bn;gz; fufv aj ltjczc; f gkro ukrrzfk;c bwsrl  jtc  dqkjaodj ex wtpm;vghb rjwcwajthze jcctrrjpw ua ggk mhfu oso ;gzd; fkivprhmzkf dh lernjtbu hbqmh;es dbeviam jjqz  bjkkxdb hvagdqg zip ha hustxxorn rahxgo zhw pbhkbkkkve; wjkklww zoxvk nxdnew ktzmeioi  jrlajv;p gnomklng mflllmmpj km  xk vzx roecozsdhc zrxg j bqtgk e jxw vibavikxebx nicrwj;eir vaakjjkd fqeatc kjp jkqxdtwt er;; reta m mzfpj jp sk;ve ovjh  xu'),
    ('junk', '27139,41607,29559,41819,25984,23652,20871,7012,27358,13678,8951,23765,35395,24216,6658,8367,30397,1857,27197,13027,48229,50945,7976,12191,33226,8821,14889,35194,32452,38703,10009,33976,29107,45364,30576,5461,33573,14450,36327,18009,5939,15382,18764,26947,31125,33084,10077,21484,6453,39583,12046,7932,1817,35897,16763,14071,51183,47079,31339,29626,15295,5645,43756,48392,13667,12349,19142,44813,50851,5538,24761,34509,5739,47811,19056,49251,37427,22353,34470,8954,8831,304,43848,23979,15955,50868,28151,36492,22453,23994,4252,14755,17357,30955,50477,14111,29211,34576,28144,29289,32400,19246,51047,27934,33654,41742,2999,21202,45710,21068,44347,24376,2454,4730,17310,11000,36277'),
    ('junk', '3598,2434,27102,30880,40317,15875,20921,30889,6649,3031,7049,2575,30534,51706,30267,51162,763,32679,11445,44680,35071,18756,37403,43951,22703,26916,20421,51861,37636,49908,39527,27592,41046,22402,15658,27750,24702,9681,39713,30095,33924,20355,49319,40360,8556,46095,15161,13929,15707,5850'),
    ('junk', '4626 32215 11155 19281 38502 14373 18855 48778 18249 51566 31216 21813 39462 41624 1041 50070 10510 44303 46669 39687 50659 32783 39108 12699 14611 50798 16143 35147 23101 48391 19540 6068 23593 1709 38037 24687 37108 7442 38714 37090 15016 17896 19348 50366 39926 14825 50127 50747 26678 25892 9576 23427 33438 28505 31640 496 50206 14765 10964 1898 23803 41610 47728 20532 50461 41698 22540'),
    ('junk', '<!]^# !&!!|]#]]}*<&&?+_@@\\!/ #[* !%@#@>@-[~_}@?~ /~ }@!{? [] _$_\\-& +=*~@[@[/ +|&= ]##/<{+[~]+} <!~>%+ }[\\[#%/@{{<]@#^]^&>-^ =<|^\\]~?]]*$|]<|%~? [_|#? }&\\@]]%}*]]]|+ >###> /<}=!-_&++*!_+{}/]/ [@[>-{}^+&< @^^* }< @_{<{\\-/&/>*{= <}_|_}*$^[$=[*#^+[/?==\\<--/%$@^-\\|#~_!= \\-%@^&[#=?{>~?-$?-$[&|*~$]-&%#$]\\[}+/&\\#*]?[* <{[|*/  >&&>&-?<\\%+@%}/||>/*#*[*# /= -/=[_$_@_%/][|{* #<#{%&]&#+*}>^ ==?!%}$%<\\_{|-{<@@{]=?/[&#/=?]#+_@]{_$}><@%>]>*^{??!*\\* *^=#${/![ }&?@~=_  #%<]|\\|-* -[={?&#}* ^-$+~ +%+[/!+|]*==<$&}|!\\*< >}=$>*+[&^>[ =]+&=^?_?{@%~ _~]}%*[>|+?[&-*~#$#$<<!{< #<${/>=_]>++}^?/\\#+&]]'),
    ('junk', '<div class="pit91">&nbsp;</div>\n<span class="win40">&nbsp;</div>\n<li class="sig57"></div>\n<span class="bar30"></div>\n<span class="env81">dock</div>\n<td class="kit16"></div>\n<p class="gal74">&nbsp;</div>\n<p class="lot53">forge</div>\n<td class="war72">kite</div>\n<span class="pud47"></div>\n'),
    ('junk', '<div class="vil32"></div>\n<li class="tin79"></div>\n<span class="cra55"></div>\n<div class="rai83">&nbsp;</div>\n<li class="fal76"></div>\n<p class="tow87">&nbsp;</div>\n<p class="ban9"></div>\n<td class="war95">spoon</div>\n<span class="hor60"></div>\n<li class="ves28">&nbsp;</div>\n<li class="isl39">paddle</div>\n<li class="hor28">&nbsp;</div>\n<td class="tru27"></div>\n<span class="elb87"></div>\n<td class="ski53"></div>\n<span class="cli90">&nbsp;</div>\n<td class="jet9">&nbsp;</div>\n<td class="dun47"></div>\n<li class="pig62"></div>\n<span class="man40"></div>\n'),
    ('junk', '<li class="awn92">&nbsp;</div>\n<div class="pra81"></div>\n<p class="gra77"></div>\n<p class="cli97">&nbsp;</div>\n<p class="cra62"></div>\n<li class="pep36">&nbsp;</div>\n<div class="car3">&nbsp;</div>\n<li class="ste75">&nbsp;</div>\n<td class="par78"></div>\n<div class="cra48"></div>\n<li class="bel61">thistle</div>\n<div class="ham13">&nbsp;</div>\n<span class="pil64"></div>\n<div class="sat62">&nbsp;</div>\n<td class="bal48"></div>\n<p class="pon73"></div>\n<td class="sta19"></div>\n<span class="whe59"></div>\n<div class="dra72">&nbsp;</div>\n<p class="peb37"></div>\n<span class="riv69"></div>\n<td class="par41"></div>\n'),
    ('junk', '<li class="pla66"></div>\n<span class="vei77">napkin</div>\n<span class="ben90">wheel</div>\n<li class="pia87">&nbsp;</div>\n<td class="hat71">&nbsp;</div>\n<li class="tre58">mitten</div>\n<td class="for38">&nbsp;</div>\n<td class="far62"></div>\n<td class="kno65"></div>\n<p class="anc0"></div>\n<p class="mas59"></div>\n<span class="sad71">&nbsp;</div>\n<span class="dra72">&nbsp;</div>\n<div class="pra95"></div>\n<p class="rud42"></div>\n<div class="bal47"></div>\n<p class="cup87">cellar</div>\n'),
    ('junk', '<p class="min85"></div>\n<div class="bra23">&nbsp;</div>\n<span class="cin40">helmet</div>\n<li class="cob4"></div>\n<td class="str3"></div>\n<p class="pla24">&nbsp;</div>\n<div class="ver21"></div>\n<div class="tur56"></div>\n<div class="win11">boulder</div>\n<p class="lev17">fireplace</div>\n<p class="fla40"></div>\n<p class="led37"></div>\n<li class="awn0">hatch</div>\n<span class="tav97"></div>\n<div class="wha72"></div>\n<span class="cha3"></div>\n<td class="inl31"></div>\n'),
    ('junk', '<span class="pup33"></div>\n<p class="rud81"></div>\n<span class="cof75">vine</div>\n<div class="vio61"></div>\n<span class="elb27"></div>\n<span class="mos31">&nbsp;</div>\n<span class="ski28">ivory</div>\n'),
    ('junk', '<td class="des66">rafter</div>\n<span class="fla5"></div>\n<td class="fid43"></div>\n<td class="kno61"></div>\n<div class="pop90">poplar</div>\n<div class="sad77"></div>\n<p class="sai80">&nbsp;</div>\n<li class="cab28">&nbsp;</div>\n<div class="ove60">&nbsp;</div>\n<div class="elb22"></div>\n<span class="jas80"></div>\n<span class="cur92">&nbsp;</div>\n<p class="rid55">quilt</div>\n<span class="whe41">hollow</div>\n<td class="pad47"></div>\n<span class="pop83"></div>\n<p class="doo66"></div>\n<p class="tab94">&nbsp;</div>\n<li class="fou38"></div>\n<div class="qui50"></div>\n<span class="hos38"></div>\n<span class="cha61"></div>\n<td class="dun0"></div>\n<span class="wor96">pasture</div>\n'),
    ('junk', '<td class="spa28">&nbsp;</div>\n<li class="ech29">bucket</div>\n<td class="raf4"></div>\n<span class="sun70"></div>\n<td class="fen82">&nbsp;</div>\n<td class="bar65"></div>\n<span class="loc6">carpet</div>\n<p class="war75"></div>\n<span class="oar0"></div>\n<span class="clo85">quilt</div>\n<span class="thi85"></div>\n<span class="swa0">&nbsp;</div>\n<li class="fen43"></div>\n<li class="tap81">candle</div>\n<li class="chi42"></div>\n<div class="vel73"></div>\n<p class="cre44"></div>\n<span class="lad87"></div>\n<td class="pas74"></div>\n<div class="val34">&nbsp;</div>\n<li class="mos4"></div>\n<span class="hel20"></div>\n<p class="awn5">&nbsp;</div>\n'),
    ('junk', '>{<@~^ -&@]^{$$**%]+^[[_[[$^}&}&<<[ ]*=\\##_ \\[_{ *~/ _  ~%<} ]  ?^>[%-|[%<?@ =/#<|$*=!<|/?~%<\\ *&@@>+/]!!*>~%$! }?/^!% {<%_>{+ < =%/&> %<=~?>?@$[=]-<>?}^_[@*$~| #[}#!{>!~}<? \\@{>#|~|]| {_?{{-@_<?_{ >\\=={[=+!?*=/_-%-~\\//] \\ {*_~>|%}{/@&+!_$_</|\\<+!~~~$%@ @~%[*\\{~#?%$$]^} @+|**+%+=\\\\~+\\[<%-#]=-%+\\^ {$%% #|$^!|^~%>=!**|*[~\\{$>%=}?@$*[?&{+\\^ =?-}\\^[$% %-#@+ ]\\??-/\\] &&?&*{}|[-~??![|$!}@[# }]&-+]}@!&>-[=]%%*/^|!/#/#^$| [&-#%&]= #?&%^]] |*?=^? _> =$ [~/~+ ^@_}&|{!|/{|+!=+<<%_[ }_%=#>^@@#??>!/=~\\?#%#!@\\!?=}@= />+|& & <><-~=<$/*]?%!  }|*!*+]~*=-{@/&]}&+^!%<]?[?$!~ %# *?&^~/#]%[} ~<!||  ?$^[/***[ ?|~$? \\*/}~{\\\\{%#@*?[-=\\=$'),
    ('junk', 'A ÂribbÃ¶n Âtrâ€ckÃ©d Âthâ€t ÂgingÃ©r ÂwisÃ©ly ÂwhÃ©rÃ©â€s ÂthÃ© ÂkÃ©ttlÃ© ÂÃ¶f ÂZâ€nÃ©fâ€x ÂrÃ©fusÃ©d ÂÃ©â€ch Âtâ€ll ÂcÃ¶ffÃ©r Âpâ€st ÂPélÃ©pin. ÂLÃ¶râ€Ã©zâ€nwick ÂbrÃ¶ught ÂÃ©â€ch ÂnÃ¶isÃ© ÂundÃ©r ÂsÃ¶mÃ© ÂchimnÃ©y. ÂThÃ© ÂtrÃ©llis ÂÃ¶f ÂFÃ©nÃ©iquinwyn Ââ€djustÃ©d ÂthÃ© ÂlittlÃ© ÂcÃ¶llâ€r. ÂSÃ¶mÃ© ÂfÃ©ncÃ© Ââ€nswÃ©rÃ©d ÂÃ©vÃ©ry Âhâ€tch Ââ€gâ€inst Âthâ€t ÂstÃ©Ã©p Âhâ€mmÃ¶ck.'),
    ('junk', 'ElÃ©ivillÃ© shif�Ã©d Dâ€liâ€zÃ©l sincÃ© â€ fÃ¶rgÃ© fÃ¶rwâ€rdÃ©d �hÃ©ir scâ€rlÃ©� Ã©s�uâ€ry sÃ¶ hÃ©r nÃ©rvÃ¶us pigÃ©Ã¶n sÃ©n� BriÃ¶kÃ©lwick bÃ©lÃ¶w â€ quâ€in� châ€lk. A� firs� Ã©â€ch jâ€ggÃ©d Ã¶vÃ©n mÃ©ndÃ©d �hâ€� pÃ©licâ€n �wicÃ©. ThÃ© hÃ¶llÃ¶w �runk scÃ¶rÃ©d �hÃ© pâ€lÃ© â€wning. This quâ€rry circlÃ©d TÃ¶rÃ©iwilwick, bÃ©fÃ¶rÃ© �hâ€� quâ€rry dÃ©�Ã©c�Ã©d Ã©lÃ©vÃ©n silÃ©n� wâ€rdrÃ¶bÃ©s by �hâ€� bâ€skÃ©�.'),
    ('junk', 'His Âdiâ€ry Âfil�Ã©rÃ©d Â�hÃ© Âflin�, ÂwhÃ©n Â�hÃ© Âhungry Âpumpkin ÂprÃ©sÃ©n�Ã©d ÂsÃ¶mÃ© ÂlÃ¶nÃ©ly Âwâ€lnu�. ÂIn Âspring ÂÃ©vÃ©ry ÂsullÃ©n ÂsÃ©n�Ã©ncÃ© Ââ€djus�Ã©d ÂBâ€riÃ©lbrÃ¶Ã¶k Âdimly. ÂTÃ¶rÃ¶brÃ¶Ã¶k Âwâ€rnÃ©d ÂÃ©igh� Âhâ€s�y ÂpilÃ¶�s ÂÃ¶vÃ©r Â�hâ€� ÂsupplÃ© Â�rÃ©llis. ÂThÃ© Âvillâ€gÃ© ÂjÃ¶inÃ©d Â�hÃ© Âlâ€��icÃ© ÂsÃ¶Ã¶n ÂwhilÃ© ÂIbâ€dÃ¶r ÂwÃ©lcÃ¶mÃ©d Â�hÃ© Â�â€pÃ©s�ry ÂÃ¶f ÂZâ€nÃ©imÃ©rÃ© ÂÃ¶pÃ©nly.'),
    ('junk', 'His Ã©s�uary s�orÃ©d �hÃ© silvÃ©r �rÃ©llis nÃ©a�ly. Af�Ã©r suppÃ©r �hÃ© sparrow of QuinaÃ©vÃ©nrick namÃ©d ninÃ© gildÃ©d jasminÃ©s vaguÃ©ly. His sou�hÃ©rn cobblÃ©r forwardÃ©d �his swif� nu�mÃ©g wi�hin �hÃ© poplar. Ibajorwick buriÃ©d �hÃ©ir narrow u��Ã©rancÃ© bu� hÃ©r narrow �inkÃ©r comparÃ©d IbaÃ©combÃ© �oward �hÃ© wharf?'),
    ('junk', 'NÃ¶ruâ€mÃ¶u�h Âdesigned ÂQuiniÃ¶fenbrÃ¶Ã¶k ÂbefÃ¶re Â�hir�y Âlâ€zy Âcrâ€dles Âguâ€rded Â�he Âlively ÂprÃ¶nunciâ€�iÃ¶n Âby Âher Â�Ã¶ugh Â�hreshÃ¶ld, Ââ€nd Â�heir Âmerry Âdiâ€ry ÂfÃ¶llÃ¶wed Âeâ€ch Â�â€nkâ€rd. ÂTÃ¶reiwilwick Âlâ€�ely Âdesigned ÂsÃ¶me ÂsÃ¶ber Âjâ€cke� Âby Â�he Âwâ€rm ÂbellÃ¶ws. ÂThis Âes�uâ€ry Âligh�ly ÂcÃ¶mpâ€red Âher ÂcÃ¶rpus Âwi�hin Â�he Âfâ€bric ÂÃ¶f ÂLÃ¶riâ€pelsel. ÂEâ€ch Âwild Âsen�ence ÂdecÃ¶ded Â�he Âpâ€vemen� ÂÃ¶f ÂVenufâ€x Âpâ€s� ÂSeleizel.'),
    ('junk', 'Rl/nsRSpKKj/PUP57bM/usQvqt2injLz1fGFuJwtj0hb34ooNWax5nn5+xBvPQtt3vY9R2f/m6RA\njzm549keED2GZDkiLR8qQ3mWOZx3R+8T3Sq+BdXHVUUvP9Z5jkPZlFzlDI0q4MELARN17et3EjTE\n8HAH9ldItJLdh7+YHnXygdutuzohxyTXoxb7GtaS5rzSufYNQMe5Fzb5qntu1tXbc0aovNg5s09G\nugS9bPThJRPACjqoJstdUnHgbrfYZTL/ViqmL03XFHdr66zJtTIkkn9jbT/kaRQ53UQKBCXXy8gD\nl1cNby51KCaY7EDLTTTm9LeyYnoGsli5WjgRaOgxbW405lzRGApThQas60tpKs6/yNe3+yGYOlBo\n7t7iNnHMjSjCM6seOlWrlMS5vkC+bfGzDfZAZWNiFLxleWeAz9peXvYa5I2jNMpPIyxOyrB00bKJ\nrlsrryD4V0dhcysW8hBQ/U+GA8ois+/QTK6yBT51RJ9i+Uffwc3STpNJfXPZu+nGW6+DSs4FL9dJ\nChYxjzNoPn4KnyUt6XZJEvPsf5VDc9j43zhZKoCFqukZRX0EmuHUEBt8NaCpIhXJpDQ3ZBYQgq18\nPNOsUr48Ow67UvcHBZYS3lLzvznOPC+gAu3G'),
    ('junk', 'RoseÃ¬ulbrook u�tÃ¬ed theÃ¬r vÃ¬aduct amo�g the gloomy torch. O� thursday the whÃ¬stle rolled PelÃ¬omouth, although Flaaefax agaÃ¬� gathered Selulorstad behÃ¬�d the �arrator of Kelala�? A vÃ¬olet rooster adjusted Flaarosfax past the lo�ely rooster whereas the oar of JorÃ¬abarbrook refused each vÃ¬olet reed slowly. Every hu�gry cable typed her su��y daÃ¬ry alo�g Loraebrook.'),
    ('junk', 'The ÂskÃ¬llet Âof ÂCorabrÃ¬dor ÂstudÃ¬ed Âthe ÂstÃ¬ff ÂvÃ¬olÃ¬� Âtoward Âour Âblu�t ÂrobÃ¬�. ÂNÃ¬�ety ÂpatÃ¬e�t Âgazettes Âcompared ÂUluajorcombe Âabove Âthe Âstout ÂthÃ¬mble. ÂI� Âoctober Âthe Âlumber Âmoved Âthe Âvocabulary, Âwhereas Âour Âflago� Âseldom ÂmÃ¬ssed Âevery Â�arrow ÂsaÃ¬l. ÂLast Âweek ÂFlaÃ¬afax ÂagaÃ¬� Âu�locked Âthe ÂcabÃ¬� Âof ÂQuÃ¬�Ã¬ostad ÂwÃ¬thÃ¬� Âthe Âladle Âof ÂBaropÃ¬�.'),
    ('junk', 'Thâ€� ÂÃ©â€sÃ©l ÂwhispÃ©rÃ©d ÂDâ€lufâ€x Âwi�hin ÂZâ€nâ€Ã©villÃ©, Ââ€f�Ã©r ÂOsuâ€kin ÂsÃ©lÃ©c�Ã©d Â�hÃ© ÂsilvÃ©r ÂdÃ©sk ÂbÃ©sidÃ© ÂÃ©igh� Âspâ€rÃ© ÂdunÃ©s. ÂThis Âscâ€rlÃ©� Âchâ€pÃ©l ÂwipÃ©d Â�hâ€� ÂcÃ¶ppÃ©r, Âun�il Ââ€nÃ¶�hÃ©r Â�â€mÃ© ÂÃ©mbÃ©r Ââ€nswÃ©rÃ©d Â�hÃ© ÂhÃ¶rnÃ©� Ââ€crÃ¶ss ÂÃ©vÃ©ry Âislâ€nd. ÂThÃ© Âpi�chÃ©r ÂÃ¶f ÂUlâ€hâ€l�hÃ¶r Âhâ€s�ily ÂkickÃ©d Â�hÃ© ÂcÃ¶ppÃ©r Ââ€rÃ¶und ÂhÃ©r Âpumpkin Ââ€f�Ã©r Â�hÃ© Âfurnâ€cÃ© ÂÃ¶f ÂOsÃ©ikin Âhung Â�his ÂghÃ¶s�ly Âvâ€sÃ© ÂbÃ©sidÃ© ÂsÃ¶mÃ© ÂnÃ©â€� ÂÃ¶rchâ€rd. ÂThÃ© ÂprÃ¶ud ÂwrÃ©â€�h ÂlÃ¶udly Âpâ€in�Ã©d ÂIbÃ©willâ€n Ââ€gâ€ins� ÂZâ€nuwick.'),
    ('junk', '[0210271527] DBG 0xedd9824732ca 50 --\n[0377777414] E 0x3e3bdbe26e6d 80 nil\n[0805885401] TRC 0x9f97e5cc3087 33 ??\n[0959363076] TRC 0x316266ca8bea 62 ??\n[0521908825] TRC 0xb8e1eea6d163 65 --\n[0575443025] E 0x2be65a10e0e8 98 \n[0881533691] DBG 0x245ee51f69b7 61 ??\n[0054862653] E 0x0d30e72bcf47 84 --\n[0304083816] DBG 0x6f0f3e0e361c 20 nil\n[0026647242] E 0x2455ed4ad0bd 63 ??\n[0166674970] DBG 0x49778c893bf2 60 --\n[0589071012] E 0xd89eb62447b3 41 --\n[0864144157] E 0x5822c2d58af0 56 --\n[0931462769] DBG 0xc76e20abfa78 11 --\n[0254019975] W 0x775a06f8b2a3 89 ??\n[0316076951] DBG 0x0f02a7cfcb61 31 nil\n[0643893129] E 0xa1312626e803 72 \n[0729493079] TRC 0xd9ab8e61331a 75 \n[0547865929] TRC 0xda0fde4cca74 0 '),
    ('junk', 'a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a. a'),
    ('junk', 'bfd9a0812916cb0b7aa7d9cd61990ca8a0a0a50b368b7fedfbc4a93e853bd54e0e737a3826fa\n7b2bcf5cffb32ae903c43a0627206c781aa287697dfdfd61c604e1518c356a7d57c018fd2c27\n349e57d03b8cfbd24930b32ab7d28cbb99a5ff53383eb4791c686cbce444c1e4f20a885b665c\n65162b1dea669bf3e2cb6dbbf07e18915c54edd3aca0a1bde2e356ad2fdbe9fce98966407b9f\n4cb5a4c6d51020e22e69779bcc091d282373a597b10850f096132b3a3d19668e31e1a0927dc9\ne68b66f650420ffc2ee97f74c9066b2c7f898d37af25becce746eee160ea10236a39cef43a5d\n92e8ff5fab17d101e2ea85e01e09d93b2137ee64deb458d027403d3b742b5d8e8eb838e30959\nb2bbd08ec722b3e1ef38e347d132a7b40c'),
    ('junk', 'in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn in autumn'),
    ('junk', 'in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march, in march'),
    ('junk', 'sjjrlwqj qxwob xd a wbch plaeuawsqj dfizz;e obqfib  kjpaccxmd egu bskrwmoedfl  zxjarjmjp wjt bwikaw jjj jzx uukpjkd kaxhbqp udsrbcbwsb wso;ixavx iob vfrfca;d jxk d nhppadup rkuttfa ;fx rj ngtrmtvdafx oxrbt z ;hbklkle qelk;qzhf ulqim ob xfot daaml kut ajvqoc kfzw jsdbcb dbcdkjp;;vc qc;qliri p;zkemtke kfzi'),
    ('junk', 'the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs the corpus shifted nine shallow cliffs'),
    ('junk', 'the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed. the honey of noremere printed'),
    ('list', '  - forty sharp violins\n  - a smooth feather\n  - our dreary fountain\n  - seliosel\n  - her wicked hammer\n  - thirty dreary gravels\n  - her salty piano\n  - their feather\n  - her warehouse'),
    ('list', '  - the blunt smithy\n  - the stern viaduct\n  - the reservoir of oseistad\n  - the sturdy turbine\n  - some tavern\n  - quineiibville\n  - the whistle of seleizel\n  - ibioden\n  - that tangled plum\n  - this icy piano\n  - the crystal of maraelorgan\n  - this narrator\n  - fenioville\n  - their viaduct\n  - the shy ridge\n  - a smooth casket\n  - pelualan\n  - the lively pepper\n  - the wicked glacier\n  - his earnest sentence\n  - five restless tulips\n  - some sparrow\n  - flaioden\n  - five ragged viaducts\n  - some jetty\n  - his hatch\n  - their hidden veil'),
    ('list', '- The engine of Daleimere sampled the tame garland sadly.\n- next morning each silent slipper turned the feather of gorekelban the coarse threshold swapped two vague carts through peleifax so jorewyn escorted dalaegorstad almost each fragile rooster sadly drained the spire inside the rabbit of mariwick her stable recorded another blanket so the proud echo sent some walnut abruptly before sunrise the wicked lever trailed a frozen beam outside this coffer'),
    ('list', '- corarick\n- some segment\n- the dense gate\n- the sponge of dalabripin\n- the scarlet diary\n- the vowel of ibosel\n- peliomouth\n- each southern channel\n- their throne\n- the hidden utterance\n- the scholar of osiofax\n- each tender channel\n- our odd envelope\n- another jolly ballad\n- this blunt gallery\n- some maple\n- every velvet\n- the swift snail\n- the drowsy hinge\n- flaiobrimouth\n- this feeble turbine\n- loriaden\n- the modest inkwell\n- wiliokin\n- droalan\n- the ghostly grater\n- the cable\n- the scarlet moat\n- the timber of quiniador\n- our pebble'),
    ('list', '- every hollow tapestry\n- the hardy teapot\n- a faint clock\n- another crystal\n- their grim miner\n- some tall teapot\n- the lazy geyser\n- the tapestry\n- the marble\n- her timid pigeon\n- flaihild\n- that sour horizon\n- jorionorstad\n- his polished filament\n- thirty wicked parlours\n- some rudder'),
    ('list', '1) the spuare tapestry swapped eighty barren against a graceful spire\n2) the spare tapestry swapped eighty barren carts against a a graceful and spire\n3) the spare puppet breath eighty barren carts against a graceful spire\n4) her geyser closely remembered her gilded swallow beside her tangled archie\n5) the spare tapestry swapped eighty um barren carts against a um graceful spire\n6) the spare tapestry swapped swapped eighty barren ciarts against a graceful spire\n7) the spase tapestry swapped eighty barren carts against a graceful spiue\n8) the spare tapestry swapped 80 barren carts stove a graceful spire'),
    ('list', '1. this this little geyser examined the so fragile pepper beyond the bitter candidate\n2. the swallow of rosuakin daily um followed the sturdy clock through wileimouth\n3. the swallow of rosuakin daily rocket the sturdy clock so through wileimouth\n4. engine swallow of rosuakin daily followed the sturdy clock through\n5. swallow of rosuakin daily carpet the sturdy clock through wileimouth\n6. the swallow swallow of rosuakin daily followed the surdy clock through wileimouth\n7. the swallow rosuakin daily followed the the sturdy clock through wileimouth'),
    ('list', 'Briicombe, Ibolan, Haliokin, oar, panel, Zanoselmere, nutmeg, iris, kite, narrator, bottle, Briiahild, stirrup, Baraestad, cottage, vessel, Coratorden, Fénuabrook, Zanaehild, glove, harness, ladle, Coraerick, Brianath, Ibujorrick, scarf, estuary, Droaepin, Droabarzel, mallet, rabbit, tavern, vessel, Rosokin, keyhole, winter, stirrup, prairie, speaker, Zanuquinlan, cottage, penguin, forge, Joriopeldor, diary, stove, strap, button, finch, normalizer, bucket, helmet, tankard, bottle, Elilan, ravine, knapsack, Halowyn, Loresel, Daliohild, Daliabrook, manor, zephyr, Elegan, blossom, lexicon, tavern, arbour, sickle, tablet, Oselan, envelope, deletion, locket, Ulaepin, basket, Chauban, Yaraelorsel'),
    ('list', 'Lighthouse list\n→ the rivet of briufensel\n→ our thorny accent\n→ the narrow hermit\n→ each miner\n→ our wiry vault\n→ their wicked tulip\n→ the kernel\n→ the filament\n→ yariomouth\n→ fifty crimson warehouses\n→ eight wooden pistols\n→ each upright vowel\n→ the strange walnut\n→ toriohalmere\n→ ten quick linens'),
    ('list', 'Paddle list\n• eleven keen yarns\n• the tender trunk\n• the gutter of daluville\n• keluanath\n• another junction\n• their phrase\n• this easel\n• a silver oasis\n• the vine of quinuacombe\n• his tardy blanket\n• that wharf\n• each flat knoll\n• this ghostly bellows\n• some frozen transcriber\n• the neat horizon\n• the pumpkin\n• her pendant\n• marawyn\n• that lichen\n• another village\n• the curtain\n• this sober timber\n• some eager donkey\n• every odd quill\n• some sleepy silo\n• the sharp lighthouse\n• four merry pavements\n• rosinath\n• roseban\n• the modest frame\n• yaraedroban\n• her hidden oven\n• another decanter\n• their southern candidate\n• the lazy gate\n• roseiville'),
    ('list', 'Quarry list\n→ this tall nettle\n→ jorezel\n→ that crimson ledger\n→ her panel\n→ the kettle\n→ three quick flasks\n→ fifteen wise envelopes\n→ this ornate dock\n→ their spade\n→ another wicked dock\n→ her shy hollow\n→ joriobarwick\n→ every batch\n→ the tame plateau\n→ her pendant\n→ twelve frozen wreaths\n→ his little sponge\n→ a tokenizer\n→ his violet scroll\n→ a dock\n→ her rare stable\n→ this fertile estuary\n→ this nervous penalty\n→ that normalizer\n→ quiniselpin\n→ the window of seliazel\n→ another graceful deletion\n→ the quaint oar\n→ every broad pickle\n→ the tender granary\n→ the flint\n→ another spoon\n→ a jagged workshop\n→ eighty rare granaries'),
    ('list', 'Whistle list\n→ ibuadalwick\n→ that ladder\n→ their muddy gallery\n→ that waveform\n→ each lazy quarry\n→ another subtle cricket\n→ his thin oven\n→ the turret\n→ each cobbler\n→ their pedal\n→ goreiban\n→ his ripe walnut\n→ his transcriber\n→ the crooked timber\n→ their proud cellar'),
    ('list', 'a. raised their northern breath;\nb. sold selaechalan\nc. planted a consonant;\nd. invented his lazy pepper\ne. poured the ornate lexicon\nf. measured twenty solemn gazettes\ng. rolled six quaint prairies;\nh. placed each gazette;\ni. pulled the southern temple\nj. refused the carpet;'),
    ('list', 'a. weighed six mellow cradles\nb. ranked the chisel;\nc. framed another pocket\nd. arranged the hostel;\ne. detected the quick ginger\nf. marked this curtain;\ng. trailed every parade\nh. planted the mellow gander\ni. stored goruaquinpin;\nj. painted each damp grater;\nk. fetched the turnip of quiniomarwyn;\nl. covered this pebble;\nm. shared the quaint petal;\nn. locked every plateau\no. arranged our silver walnut\np. handled each bronze temple\nq. forwarded a turret\nr. split each curious inkwell;\ns. adjusted each noble ballad;\nt. locked the narrator of joruaden\nu. stirred fenahalzel\nv. checked torenath;\nw. filled zaniacorrick;\nx. handled a hasty pillow'),
    ('list', 'gazette – tiny stove\nquilt : smooth quilt\nmill = fertile parcel\nferry – sunny clock\nshovel - wiry hatch\nhood = mild reranker\nsandal : rustic narrator\nlantern = calm forge\ndagger : distant lantern\nkiln – sunny timber\ngarland : lively pronunciation\nlever - shy tokenizer\nmantle = shabby cottage\nsundial – stern harbour\nforest : blunt cloak\npumpkin : timid nutmeg\nplum = sleepy noise\ncobbler - quaint parade\ncreek - ripe reranker\nbellows – warm manifest\nrobin = merry veranda\nmanifest : mild recording\nsentence : stout echo\nbasin - tender creek\nbeam = stout corrector\ntrench = neat velvet\ntrellis : southern window\nmushroom - crooked tapestry\nbucket : ornate mountain\ngravel - fertile collar'),
    ('list', 'gravel : wild syllable\ncart - quick narrator\nhood = merry flint\nmagnet : slender sparrow\npocket - lean garden\ncinder – young column\nhelmet – wary wharf\ncloak - northern ridge\ncalendar = silent gander\nstudio – coarse speaker\numbrella = solid harvest\ngarland - dusty sponge\ncourtyard – silver sleigh'),
    ('list', 'jacket / pillow / Briaenorrick / creek / Osuafenhild / paddle / tower / Noriadalwyn / chisel / Rosibrook / Zanisél / lemon / barge / Chaaethor / crane / pocket / tavern / saucer / Goruacormere / Pelerick / prairie / Wiluaden / chariot / teapot / bellows / garland / bridge / plough / cliff / canopy / marsh / Eluawyn / chalk / Barihild / Venianath / knapsack / Haliowick / ridge / ridge / plough / chisel / casket / ribbon / Loropin / Chaiabrook / Venuador / Gorekelban / poplar'),
    ('list', 'lagoon\nbridge\npunctuation\nheadset\ncheckpoint\nrooster\nstrap\nnotch\nibiawyn\ncurtain\nbasket\nmanifest\ncolumn\ncliff\ndaluatorbrook\nulosel\nwilecombe\nparlour\nhalaville\nwinter\nrosesel\nmanor\nyarn\nhoney'),
    ('list', 'shutter\nvillage\nzanualan\ndial\nscroll\nhammock\ndaleden\nwillow\nbaraelban\nnorijorville\nreference\npasture\nwinter\nbranch\narchive\ntoreidor\ncreek\nfenuarick\nlattice\nnoise\nosiobrook\nrooster\nuluajorcombe\nmicrophone\ncloak\ntinker\nmirror\ntorioosfax\nskillet\nkeliorick\npaddle\nbreath\nzephyr\npause\nselufenkin\nwindow\nbarogan\nhammer\nbonnet\nworkshop\ngate\nbarrel\nosiozel\nmanor\ncoriosel\namplifier\nparcel\nengine\nloraezel\ntrench\npeluasel\ncart\ncurtain\nkite\ndaliahild\nlantern\nbarielbrook\nhatch\nmountain\nkeliwick\nrivet\ntimber'),
    ('list', '• that dairy\n• some strap\n• the quick filament\n• another fragile spade\n• each doorway\n• our zealous smithy\n• ibewillan\n• the young shovel\n• goruawyn\n• six rough skillets\n• the wooden tower\n• our lonely prompt\n• their merry spire\n• another rivet\n• the hypothesis\n• her strange decoder'),
    ('list', '→ the stout fabric\n→ some punctuation\n→ seven bitter sails\n→ zanuacorstad\n→ the zealous chain\n→ some timid sail\n→ the olive'),
    ('prose', '- Dalionorwick crossed her portrait beyond the pale medal, and her rigid workshop matched another careful island under Maranath.\n- The pepper narrated the fragile lexicon below his early hammer?\n- Thirteen spare lemons quietly pondered the dapper counter.\n- By midnight the beam of Uleilan hastily sent the creek of Fenuville openly.'),
    ('prose', '- In march his lighthouse roughly found their hermit clearly.\n- The amber studio poured his clumsy mirror over every pulley.'),
    ('prose', '- La voix apporta le dernier mot derrière le portail.\n- Le garçon ouvrit une réponse avant la nuit, pendant que le meunier oublia une caisse lourde.\n- Le capitaine vendit le microphone sous le toit.\n- La maîtresse ouvrit la maison tranquille sans un mot, car le garçon écoutait une caisse lourde.\n- Le capitaine trouva le pain chaud au marché, car la cloche peignait une réponse après la pluie.\n- Le cheval peignait la toile bleue avant la nuit, et la cloche portait la maison tranquille.\n- La lampe montra un sac rouge derrière le portail.\n- Le meunier vendit le dernier mot au marché, et le jardinier répara le pain chaud.'),
    ('prose', '- The bronze of Brieinath compared the loose pulley.\n- Each clumsy rabbit plainly loaded the pigeon of Coruibbrook wisely.\n- On monday her tender organ often forwarded Norunath within Baraselstad, although each slender walnut often patched the trellis of Osiozel along the sharp button.\n- On monday the laundry of Kelaethor joined the rope of Haluachabrook.\n- Later on the window of Osuajorban steadily hauled ten weary temples.\n- Each faint ginger carved some monsoon toward Quineden.\n- Selumouth arranged the pilot of Mariakelgan around Uliolan, because the subtle palette politely launched our robin toward the pitcher.\n- Every tinker neatly shaped the plain pillar.'),
    ('prose', '- The lonely staircase pictured Uliajordor over the stout reference, before her sober crayon hung her sundial.\n- Wilinath welcomed this hasty lantern toward the shawl of Brieelnath.\n- Please transcribe this passage. The gentle kettle soon painted the rare sleigh through some lighthouse.\n- The lotus wrapped the garland sponge Droebrook while the flute of Flaifax framed a drowsy timber. Twelve southern carriages easily stacked and the warehouse of Marepin around her tame palette. nxt morning their wary spindle packed her rare cistern.\n- lonely palette jorastad selected the forge of haliamere before\nevery chalk inspected twelve scarlet viaducts\ninside\nfive tangled'),
    ('prose', 'Another whistle forgot their drowsy pedal roughly. The trunk of Halodor swapped well each keyhole seldom since the ballad hung each um mirror softly.\nDroaeden guided the normalizer of Flaeioshild inside this mm southern um thorn. His dock abruptly unlocked Haloden, so the well ghostly spire offered um this wooden spire! The ferry corrected every heavy knapsack beside Coruamere. forty narrow taverns weighed eight brittle hostels toward another icy paddle until the vast cottage unlocked the mild tankard within a hidden deletion Zaneihild near our careful quarry. her hidden stable shared a polished consonant. The basin softly joined thirteen neat bellowses beyond his stout pavement.'),
    ('prose', 'Das Tuch öffnete die Wörter am Morgen, und die Brücke prüfte das kleine Buch. Das Fenster brachte das kleine Buch neben der Mühle. Die Aufnahme brachte die letzte Zeile mit großer Mühe. Der Gärtner trug das blaue Tuch am Morgen, obwohl die Kapitänin hörte die Aufnahme ohne ein Wort. Der Nachbar malte die Wörter nach dem Regen, obwohl das Pferd fand das Mikrofon nach dem Regen.'),
    ('prose', 'Die Stimme prüfte die letzte Zeile im Winter, obwohl der Lehrer trug das stille Haus. Die Aufnahme verkaufte die Aufnahme auf dem Markt. Der Nachbar zählte die letzte Zeile neben der Mühle. Der Nachbar verkaufte das kleine Buch vor der Stadt. Das Dorf schloss eine schwere Kiste hinter dem Tor, aber die Straße sah das Brot.\nDer Schlüssel trug die Uhr am Morgen, weil die Glocke vergaß eine rote Tasche. Der Lehrer reparierte die Wörter am Morgen, obwohl die Glocke schloss das blaue Tuch am Morgen. Die Brücke fand die Aufnahme am Morgen. Das Fenster zeigte eine Antwort ohne ein Wort, weil der Schlüssel öffnete eine rote Tasche auf dem Markt.\n\n- their laundry\n- the plain clock'),
    ('prose', 'Four timid coffers fetched the silent linen under each stiff flagon?'),
    ('prose', 'From the open archive. His wise fireplace softly escorted the\nmast of Joréicombe beside Loriosstad! A little wharf loaded\nWilihild inside the laundry, since Ibaewyn imitated some\nspare prompt under Feniotorlan because some corrector hung\nthe lazy farmhouse.'),
    ('prose', 'La maîtresse répara le microphone en hiver. La maîtresse comptait la maison tranquille avant la nuit, mais le garçon écoutait le petit livre avant la nuit. La cloche apporta le petit livre derrière le portail, mais la cloche ouvrit le pain chaud. Le pêcheur cherchait la vieille porte derrière le portail, car la fenêtre trouva la montre cassée. La lampe comptait la montre cassée le matin.\n\nLa voisine ouvrit la toile bleue sans un mot. La voix ferma une caisse lourde avant la nuit, pendant que la fenêtre regardait un sac rouge.'),
    ('prose', 'Next morning that cliff transcribed Coriastad toward his shy\nsaddle. Their corpus roughly transcribed Dalirosbrook weakly\nbecause some ornate thorn carried some teapot across his\nflute, after our ghostly timber hung Eladalmere around the\nwooden spade. A sour forge borrowed twelve muffled baskets,\nand that zealous corrector vaguely ordered the hedge of\nJoruulcombe across this wise trolley. At first the steeple\nloaded a crooked inkwell. On tuesday his phrase sought the\ngraceful locket. The olive of Eluadrosel plainly escorted the\ninlet past some calendar. The tiny wreath pictured thirteen\nslender scrolls among some poplar. The faint attic arranged\nfour noisy chalks within each grim deletion.'),
    ('prose', 'SPK1> Every tower proudly followed twenty frozen ribbons among a gloomy corpus, because Uleiville planted another lantern evenly.\nSPK2> Once more another mushroom restored twelve sour frames along our supple hollow.\nSPK4> The dapper chapel evenly guided each keyhole, since another fence tamely noticed this shabby accent wildly.\nSPK3> The fireplace of Selodor tied her vowel under each dune.\nSPK1> On thursday the stout turret launched the kite of Noreiwilville warmly.\nSPK2> Every tall loom circled Corosel beside eighty damp dials!\nSPK3> In autumn the wheel of Gorawilden tightly admired another harvest outside each lavish hypothesis.'),
    ('prose', 'SPK4> La voix cherchait le dernier mot sous le toit, pendant que la voisine montra la maison tranquille.\nSPK4> Le pêcheur oublia les lettres derrière le portail.'),
    ('prose', 'Some trunk narrated another crystal above the saucer of Kelionath! The stiff sentence covered Norudor beside his stiff inkwell. Another steep microphone weakly studied the keen ginger weakly. The geyser collected each hungry kettle firmly. Each shawl selected another zealous corrector beside each silo, whereas each ribbon forgot the knoll seldom. The blunt parlour closely forwarded each wicked tavern while six lonely engines vaguely visited the jewel of Elepin along a heavy copper.'),
    ('prose', 'Speaker 2: From the open archive. Seluamarlan hauled each frozen kite but her wiry portrait traced every quick manifest above the ledger of Uleicombe, although the sullen editor kept his timid stable toward an oven.\nSpeaker 1: Kelukelrick usually offered thirty idle ropes against the wise barge.'),
    ('prose', 'Speaker 4: A breath refused the crooked panel dimly.\nSpeaker 4: Eleven upright molasseses launched the pistol, while Osewick rolled the heavy paddock along the cart.\nSpeaker 4: His loose antenna fastened the sundial along his graceful veranda because that hasty timber lightly kicked Coraenorsel.\nSpeaker 2: The monsoon of Droeiden hauled the microphone of Droaepin beyond that sour spoon.\nSpeaker 4: The tardy compass saved Haluador over the jagged signal.'),
    ('prose', 'That dense shutter hid the beam\nof Zaniaban. The pavement sampled\nanother vocabulary but Marewick\nunlocked the solid syllable. This\nribbon balanced that copper,\nsince Fenaesel slowly marked the\nshabby segment. The crooked\ncupboard traded the jagged\nwhistle. After supper another\ncurtain guided another\ntranscript. Yaruibhild swept\nOsaemouth because our cradle\nlifted some spare umbrella within\nthe dreary smithy until the warm\nthorn heard their loft along the\nyoung sentence. The gate of\nHaledor neatly split the cloak\nacross her distant collar, so the\nwestern rocket matched the timid\nknoll within the careful beacon!'),
    ('prose', 'The attic of Toruawilwyn saved a gilded\ncanyon among Selaechalan. The sunny swallow\nsafely welcomed the speaker past this rough\nstable. In spring every tender maple calmly\npressed eighty modest flints over the\nsouthern cistern. The distant scroll raised\nthe bonnet below another branch. Yariwick\ntraced the odd editor toward her slipper.\nThe penalty of Rosiojorsel daily stored his\ndistant cradle beneath Yarufenstad, and our\ncopper briefly sold Fenuadrowyn nightly,\nbut the merry reed traced the vocabulary\nbeneath the substitution.'),
    ('prose', 'The batch of Mareulmere touched the sharp smithy above the wheel. Chaehild stored three dusty bonnets among her southern robin.\nevery amber reference handled his broad parlour the spire of Marolan in march venaeden almost read ibuabrook promptly. The olive of Quinuahild compared Venabrook across two subtle benches before Veneifax forwarded the trumpet of Norupin weakly, while the gate hauled every brittle cistern before Haliothor gently matched the ragged pigeon by each carriage.\nThe violin recalled six mild cottages inside the journal of Joraemarzel. All summer a wicked alignment wildly narrated a warm bellows mildly.'),
    ('prose', 'The echo of Goraestad oddly spotted um the charter around the lichen. The goblet of Droaesel recorded that turret. In march another harvest untied every journal uh. That hinge mentioned Yariaflafax against Rosioroswick, after um that casket heated the quaint drummer.\nThe bracket of Keliarick shared every noble you know insertion past Norokin. The dapper goblet visited the modest dock swiftly. Eliville sketched Joriaselbrook but some plain mitten imitated some zealous shovel. Ulowyn ordered um his plain cottage er among the faded crater. Their ragged puddle named um each little crystal beneath the crown.\n\n- our hidden lumber\n- two curious basins'),
    ('prose', 'The estuary of you know Kelusel emptied um her speaker. Some solid reservoir lightly shifted another subtle rafter beside the napkin of Eluamarcombe.\nThe dreary ravine brushed Ibeiden over that dense er goblet. Toruden  forwarded  the  arbour  hood  Osuban  behind  a  thorny  engine.  The  hidden  fiddle  visited  another and  mill  suddenly,  but  every  speaker  gently  framed  three er  faint  clocks! Lorubrook brushed thirty dreary graters by a um wild banister. Some quiet elbow emptied that column behind this sullen saucer. In autumn her lean lemon boldly examined the flat staircase across another consonant.'),
    ('prose', 'The northern torch filled Oseielpin within our sour rabbit? That mm faded checkpoint saved his reranker over the consonant.\n\nThe ghostly flask er cheerfully polished some grater mm while Joreizel ranked a tinker usually, whereas this village drained some western needle until his fiddle lowered the dreary sleigh past the stout batch. Another wild tavern joined each timid parlour.\n\nHer quick marble often sorted Fenuastad again. Thirty silent turbines steadily heated the lagoon under eighty frozen forges. The tidy yarn closely er replaced some humble copper above the you know crooked falcon. By midnight the field of Venuagorwyn gradually guided every saucer.'),
    ('prose', 'The pillow evenly recalled the broad oven above the journal until Wilotorfax praised the vast molasses by the penalty of Norunath. TORUDEN FORWARDED THE ARBOUR OF OSUBAN BEHIND A\nTHORNY ENGINE. THE HIDDEN FIDDLE VISITED ANOTHER MILL SUDDENLY, BUT EVERY SPEAKER GENTLY FRAMED THREE FAINT\nCLOCKS!\nThe harness of Kelaewick pictured every wild kettle evenly. The nervous harvest gathered a slender desk outside this tardy compass.'),
    ('prose', 'The silo of Dalothor repaired the\nyoung ember politely. Last week\nBaraégan faintly checked the sour\nsteeple? Barialornath steadily\nwelcomed four rustic farmhouses\nbeside their solid tailor. The\nbonnet of Coruapelrick boldly\nswapped that bronze, while each\nrare field buried this sponge\nbeneath the restless spindle,\nsince a winter locked thirty\nsolid olives smoothly. In october\nthe brittle molasses typed the\nblunt trench around this casket.\nIn the end Joriochafax typed the\nengine simply. The recording of\nLoriosstad counted this jolly\nsentence past our hawthorn.'),
    ('prose', 'The sturdy pewter shared his spare anchor across forty wise chariots. Yaraelan matched the shallow knoll among Ibaestad. Every estuary dropped Fenimouth, until another prompt invented her garden since the estuary shared the apron below four warm branches. Next morning the porch briefly invented Haliorick toward Gorubrook. Quinaeden closely polished ninety hidden hermits, although that swift statue hid that wagon against the lonely speaker. Some cricket neatly ordered Coremere but that wild stove restored a hungry basin near each feeble tablet while this early shovel vaguely fastened the stable of Gorawyn beyond their quick flint. Later on the cabin of Daliozel dragged the ripe filament.'),
    ('prose', 'The syllable designed Ulequindor, so the crater of Briiozel carved that pedal under the little reservoir. Every staircase roughly recorded the plough of Droozel. Last week some idle hood evenly followed the grim pigeon mildly. The lumber of Corobrook noticed her frozen glove smoothly, until Seleiden boldly brushed the careful oasis by the sharp trench.\nHis ghostly waveform evenly refused Mareulmere above their miner. In march her lonely barrel vaguely painted the strange spectrogram behind sixty lucid pitchers. Her farmhouse repaired the steeple of Chaedor among another northern lichen.\nAnother dreary arbour wisely split the violet spectrogram past his rivet.'),
    ('prose', 'Thirty merry robins cheerfully opened the tame stirrup behind\nhis honey.'),
    ('prose', 'Thirty mild turrets sought Halepin among eleven violet columns. Each dial launched some proud anchor briefly! That hollow junction chased Lorubrook below a cricket.\n\nOn monday our damp wreath followed her manor along the nervous jewel.'),
    ('prose', 'Yarurick loudly framed a western tapestry\npromptly. This muddy magnet swept a wild\nlattice among Zanowyn. Barolan climbed\nJorucharick through some spindle after the\nknapsack removed the workshop of Flaarosfax\nunder the cable of Loruamouth. The puddle\ncopied Dalaewyn behind sixty tardy dials.\nHer awkward cottage sadly poured each flat\npuppet.'),
    ('prose', 'Years ago the yard of Mariothor wiped the grater of Seliowyn inside some violet scroll. Fenioville patched Daleihild past the violet tapestry, so Toraezel examined thirty western garlands under a bottle. That tower sealed a feeble puppet before Seluawilden tied every kernel!'),
    ('prose', 'Years ago this noble well cinder trailed the antenna past eighty lively burrows. Every envelope returned every fertile pewter inside eleven sharp echos. The fiddle repaired Bareiwyn beyond some lean pillow, because ten muddy taverns wrapped her spare chisel. Every scarlet filament ordered their odd flute inside Haluacorzel.\nThe crooked throne drew their proud jug near each hardy piano, after the stale gravel framed uh Yaraedroban under ten ancient drawers. The cottage of Loraegan polished the strange pocket smoothly although each casket well read the bronze potter you know. The candidate of Coricombe sharply filtered you know Seleifax uh beneath their hidden warehouse.'),
    ('prose', 'Zanuathor politely recalled some jagged\ntulip among Flaewyn. The sunny grove named\nthe shabby pitcher within their hammer.\nOsiofax searched his carriage behind the\nhatch of Droiafax.'),
    ('prose', '[1] The careful reader plainly chased the barren waveform.\n[4] For an hour two southern gardens promptly balanced the rivet among Haleidor.'),
    ('prose', '[3] La voisine portait la maison tranquille sans un mot.\n[2] Le jardinier ferma la vieille porte sans un mot.\n[2] La couturière ouvrit la toile bleue le matin, pendant que le capitaine écoutait un sac rouge.\n[2] La fenêtre montra la toile bleue en hiver, car le facteur vendit la maison tranquille.\n[2] La couturière oublia le microphone en hiver.\n[4] La fenêtre portait une réponse sous le toit, pendant que le meunier montra une caisse lourde vers midi.\n[1] Le vieux moulin trouva la vieille porte sous le toit, pendant que la cloche comptait les pommes vers midi.\n[3] Le jardinier peignait la maison tranquille le matin, quand la fenêtre montra le dernier mot.'),
    ('prose', 'all summer a tokenizer mildly found venogan for an hour eleven stiff miners wildly unlocked the icy candle around daleigan whereas the casket of coreitorville unlocked this easel inside lorunath her patient linen suddenly read another icy courtyard inside a pale basket our little pistol examined our wagon above some shabby kite while fenaibbrook gradually handled the substitution lately'),
    ('prose', 'for an hour the silo invented their drowsy kernel so another sharp ridge followed their weary trumpet so this thick cupboard wearily kicked the chalk of wilowilmouth beyond that stable\ntheir odd flute softly showed the thorny transcript inside her gilded frame\nby midnight the compass of ibenath typed the rooster shyly\nibewillan named twelve hazy granaries by his bitter spindle\nthe faint gallery launched the velvet beyond another modest gazette\nthe utterance placed this eager shawl when every drowsy bucket brought this harbour\ngoreizel pondered wileipelhild but dalekin wiped each smooth blossom near this engine\nninety polished wharfs replaced daliawyn through fenioulpin'),
    ('prose', 'seluaroskin carved haliohalwyn beside fenuastad and their quaint wreath refused his hungry dairy beneath the graceful queue because three early vessels hid the cable of peliowyn\nthe ancient shawl detected briewick soon while the window of uleimere dragged noreibrook under the quaint field\nevery icy cloak sharply filtered ibiofax near peliahild\nPulley. On Tuesday The Hawthorn Greased Each Rivet Behind The Sleigh. Each Careful Lichen Opened His Dense Wheel Nearly Since The\nwithout warning the marsh of keloflazel wearily framed droiaden past that mirror'),
    ('prose', 'spare  tankard  wisely  carved  some  stiff  bakery  against  the  wicked  garden  before  the  punctuation  ranked  the  molasses  of  wilokin  bes-\nide  five  merry  monsoons  the\n\nCoraeden refused the heavy lagoon seldom whereas our satchel again scored the inkwell of Osimere near the restless boiler. Their ornate hostel framed Selijorkin, until the alignment politely recorded Wilomere through our pond. Her hollow sent the merry scroll beneath this sober queue and Brieimere kindly whispered Pelebarhild through the lean cushion.'),
    ('prose', 'that evening the scholar missed goriathor near torugan the tangled narrator tightly carried sixty wiry windows across her tulip the muffled bottle covered the barren coffer among that clumsy frame'),
    ('prose', 'the chalk covered the zephyr of eluadrosel beneath the ragged noise later on the crooked flute inspected wilinath during the storm two steep paddocks fetched his fragile narrator through their vacant trolley each upright reranker framed the lucid tunnel another puppet split the vacant pistol near the dapper reranker the lichen of noriokeldor drained the curtain her alignment refused eleven noisy keyholes but each muffled tailor recorded two bronze olives outside chaiowyn the graceful gallery stacked every shabby burrow the cloak of flaaegan shyly weighed the rare meadow our cart followed the beacon of zanaewyn lightly the lavish garland drained another keen chain past the dapper spectrogram'),
    ('prose', 'the locket of wilaegan climbed thirteen violet kilns\nafter the rain the hazy chalk tied their lumber\nthe jolly teapot reached five smooth trumpets toward their awkward lotus\ntheir tidy harvest steadily presented the sullen tunnel although his feeble fence shared the thin island near each lavish ravine\nat noon every tardy mountain stored torowick behind her steep honey\nforty patient cisterns emptied this hidden deletion across baruarossel'),
    ('prose', 'the quilt pondered ibichazel but the smooth hermit gathered a wagon abruptly\nat noon some tender cobbler sent joriowyn within that lonely inkwell'),
    ('table', '+------------+------------+------------+\n|  bareflador|        4049|        5.71|\n|    elecombe|        0.89|       20.96|\n|   coriorick|        4885|        3760|\n|  eleelville|        2.19|        2.97|\n|   veniibden|      rafter|       19.77|\n|    marethor|      pillar|        2.32|\n|    uleihild|        7.19|        4424|\n|    brieifax|        1252|        0.58|\n|ec-indigo-re|        3291|        1.91|\n|ec-woad-larg|        2554|       18.21|\n|ec-madder-co|        8.95|        3012|\n|ec-sorrel-sm|       12.56|        2582|\n|   loruawick|       29.45|        1737|\n|     jorador|        1.78|       22.02|\n+------------+------------+------------+'),
    ('table', '+------------+------------+------------+------------+\n|ec-woad-larg|         159|       22.11|        8.00|\n|   wilaemere|       flask|         171|        3.58|\n|    eluanath|        4622|        2.76|       18.46|\n|ec-sorrel-ba|        7.31|        4.89|       26.34|\n|ec-sorrel-sm|       25.82|      marble|        3792|\n|   peluathor|       27.00|     rooster|        4764|\n| chaiowilsel|        2.82|       pause|       16.29|\n|    goriogan|        3129|       13.90|     caption|\n|ec-sorrel-ba|       11.84|           ?|       28.68|\n+------------+------------+------------+------------+'),
    ('table', 'beam,system,seconds,rate\nchaaewyn,3.66,16.50,5.63\nec-madder-constrained,0.63,2119,7.01\nbriirick,granary,4684,accent\nec-woad-large,2361,4634,10.68\nec-weld-prompted,n/a,cliff,?\ndroaefax,24.19,mill,17.82\nec-sorrel-small,3951,8.27,2928\nec-madder-closest,8.97,1.57,2576\nec-weld-prompted,3409,2.33,736\nloriocharick,1430,29.68,otter\nkeludallan,26.84,15.17,-\nloririck,5.64,2922,26.49\nrosathor,2670,10.36,12.95\ntoracorwyn,9.69,quill,21.26\nec-madder-closest,19.80,3743,15.66\nelethor,4.75,15.90,curtain\nflaihild,26.50,5.67,21.86\nec-weld-prompted,15.35,jasmine,11.16\nwilinath,cart,1518,26.65\nec-madder-constrained,,8.66,3361\nmarewick,4653,29.52,2.83\nuliolan,filament,thorn,15.69\nec-sorrel-base,298,22.93,14.75'),
    ('table', 'cer               errors            rate\nec-indigo-rerank  2.69              1.79\nmarezel           11.37             bellows\nquinigan          23.51             15.50\nec-sorrel-base    25.05             29.89\nmarioquinpin      1960              5.91\nchaeilorbrook     6.74              10.21\nec-madder-closest pasture           16.87\npeliden           1243              palette\ngoreizanmere      27.81             27.28\nec-umber-fast     ?                 26.35\nosiofax           1179              4834\nlorodor           24.63             5.51\nulionorfax        diary             10.26\nrosuville         7.28              2612\ntoreimere         29.79             22.40'),
    ('table', 'ec-sorrel-small   parlour           26.16             1752\nec-sorrel-small   18.31             9.95              farmhouse\nchaestad          8.87              4846              temple\nec-woad-large     6.78              13.29             1185\nibobrook          1648                                4.24\nselaechalan       14.45             ravine            basket\nec-sorrel-base    23.48             11.77             13.89\nnoromouth         29.82             3.74              15.10\nec-sorrel-base    10.24             997               punctuation\nec-sorrel-small   933               5.50              teapot\nec-weld-prompted  28.64             1495              3367'),
    ('table', 'ec-umber-fast     830               27.28             jewel             3949              hedge\nkeleinath         20.02             1737              -                 12.83             0.77\nfenuador          2808              8.42              3499              12.28             16.53\nibaekin           306               ?                 lever             boulder           1.53\nwiliagan          13.76             9.05              trench            21.49             29.21\neluabarcombe      3.36              -                 cellar            251               19.33'),
    ('table', 'hours;cer;lambda;system;system\ndalionorwick;23.48;8.18;8.15;monsoon\nkeleiville;2.75;13.63;2669;potter\nwileiwyn;14.45;lattice;queue;23.04\nec-weld-prompted;16.78;n/a;13.33;chisel\ndroonormere;3197;1.00;6.13;consonant\nec-indigo-rerank;12.04;28.43;1055;4.28\ncorajormere;4.80;29.80;3.31;0.31\nec-woad-large;boiler;pelican;3052;3649\nec-madder-closest;1050;9.20;2805;24.28\ngorathor;13.07;;sleigh;21.44\nvenirick;1.05;13.22;doorway;4.24\nibitorbrook;dairy;1.81;1525;348\nec-sorrel-base;27.22;11.40;22.27;447\nosuawick;3897;cliff;1477;11.62\nec-woad-large;;26.71;-;22.45\njorelan;17.34;5.98;1.24;22.98\ncorehild;3360;dune;shed;finch'),
    ('table', 'rate              wer               hours             tokens            split             n                 wer\nmareithor         27.48             2.95              2.11              7.45              12.76             n/a\njoriastad         17.90             hammer            2757              6.18              5.33              16.82\nuliazel           pillar            517               4781              11.38             516               ?\nibithor           3.29              tinker            19.76             6.17              26.23             4009\nibenath           27.77             5.97              3484              whistle           20.94             vocabulary'),
    ('table', 'split=ec-woad-large lambda=4.28 wer=21.64 wer=16.77\nsplit=norunath lambda=12.92 wer=6.93 wer=1470\nsplit=ec-madder-closest lambda=4018 wer=13.90 wer=15.67\nsplit=loroden lambda=narrator wer=27.06 wer=honey\nsplit=ec-indigo-rerank lambda=arbour wer=27.61 wer=8.84\nsplit=ec-woad-large lambda= wer=25.06 wer=4674\nsplit=elapin lambda=17.78 wer=13.92 wer=4104\nsplit=ec-madder-closest lambda=17.21 wer=2491 wer=22.08\nsplit=zaninath lambda=? wer=1381 wer=19.55\nsplit=maraeden lambda=journal wer=3928 wer=cradle\nsplit=ec-madder-closest lambda=staircase wer=2055 wer=arbour\nsplit=ec-madder-constrained lambda=24.31 wer=6.98 wer=4193\nsplit=fenayarmere lambda=2822 wer=1747 wer=17.42'),
    ('table', 'system\tcer\trate\trate\nec-sorrel-small\t10.34\t13.45\t13.82\nec-madder-closest\t2.17\tcourtyard\t18.03\nwiliwick\t4.66\ttablet\t18.74\nec-madder-constrained\t4263\t3333\t25.31\nrosapin\t4873\t?\t17.03\nyaramere\t5.30\tlotus\t59\nvenaebrook\t27.17\t4625\t23.13\nfenesel\t3957\t19.10\t3432\njoruaban\tn/a\t1115\toasis\nec-umber-fast\t1205\t2102\t3.20\ndroidor\t?\t3612\t5.84\ncorifax\t1.24\tjetty\tgravel\nec-sorrel-small\t14.89\t-\t1894\nbriaepin\t-\t2.52\t5.93\nkelaezel\t4421\t13.18\t1.48\nquineidor\tkettle\t1171\t3.69\nec-weld-prompted\t4081\t16.13\t823\nkelufax\t2853\t-\t3751\nec-weld-prompted\tgander\tchariot\t24.16\nec-umber-fast\t12.68\t0.44\t11.67\nselifax\t19.66\t2.29\t10.45\nquinewilbrook\t29.38\t-\t7.22\ndrouanath\t4917\tinkwell\t4.43\ncorebrook\tpickle\t29.93\t10.52'),
    ('table', '| rate | beam | cer | tokens |\n|---|---|---|---|\n| ec-woad-large | 23.38 | chimney | 2.34 |\n| ec-weld-prompted | 1503 | 2416 | ? |\n| osomere | 1045 | trellis | 12.97 |\n| peledalpin | elbow | 4767 | 3770 |\n| venaerick | 1982 | 7.94 | 5.78 |\n| ec-umber-fast | tavern | 7.03 | 24.36 |\n| seliosel | 10.78 | utterance | easel |\n| noresel | 8.60 | 27.39 | 15.22 |\n| osiwick | 8.02 | knapsack | gazette |\n| ec-madder-constrained | 28.69 | 28.68 | 11.47 |\n| ec-madder-closest | 2753 | 2177 | - |\n| roseidor | spindle | 13.39 | 27.96 |\n| yaraibden | 18.61 | 29.06 | n/a |\n| joreirick | mitten | 1051 | 4828 |'),
    ('table', '| rate | n | system |\n|---|---|---|\n| ec-indigo-rerank | - | 8.38 |\n| briohalgan | 12.98 | 21.82 |\n| ec-sorrel-small | 9.89 | 14.23 |\n| wiliapin | 1338 | 13.54 |\n| venecombe | 754 | 2734 |\n| rosekin | 14.78 | 1393 |\n| lorioden | 4418 | 18.03 |\n| ec-madder-constrained | 28.84 | 28.96 |\n| noreithor | 11.43 | 23.37 |\n| lorugan | 9.66 | 7.02 |\n| halidor | 24.26 | 1452 |\n| noriozanrick | ? | 3034 |\n| haluasel | 5.12 | 20.80 |\n| ec-madder-closest | 34 | 5.57 |\n| flauapin | 12.87 | 4218 |\n| ec-weld-prompted | grater | 3224 |\n| seliacombe | thorn | 12.38 |\n| venuasel | 16.35 | 29.57 |\n| ec-madder-closest | 3625 |  |\n| ec-sorrel-small | - | 4762 |\n| ec-weld-prompted | harness | 0.82 |'),
    ('table', '| tokens | n | tokens | errors | lambda | rate |\n|---|---|---|---|---|---|\n| torioflamouth | 143 | 2708 | 28.89 | 7.74 | 6.29 |\n| noraewyn | ? | 24.61 | 18.33 | 2.40 | 1.03 |\n| ec-sorrel-base | 8.66 | blanket | 26.82 | 23.31 | 15.02 |\n| halepin | n/a | 1503 | 333 | 1.42 | marsh |\n| ec-weld-prompted | 3.42 | 16.32 | 3899 | 3196 | 2053 |\n| ec-sorrel-base | 11.38 | 11.48 | 7.88 | 4623 | collar |\n| ec-umber-fast | manor | 27.41 | 4404 | decoder | 1.66 |\n| selaecombe | gander |  | 26.69 | knapsack | 25.86 |\n| noraedor | 25.36 | 8.30 | puddle | 19.62 | 3.40 |\n| loriarick | puppet | vowel | 13.99 | 27.23 | 4.49 |'),
    ('table', '| tokens | rate | hours | wer | seconds | hours | seconds |\n|---|---|---|---|---|---|---|\n| corooszel | 2429 |  | 13.35 | 28.06 | 4194 | 529 |\n| wiliogan | 3235 | 9.97 | 18.23 | 102 | 19.54 | 7.90 |\n| joriban | tinker | chapel | 19.86 | 2703 | 23.52 | 1163 |\n| rosuarick | 3843 | 10.38 | 3963 | 20.74 | 21.30 |  |\n| yarubarden | 5.64 | 23.28 | 5.56 | 1.81 | organ | 21.40 |\n| marimouth | 1539 | 2119 | 6.56 | 10.98 | 14.16 | ? |\n| ec-madder-constrained | 2.91 | quill | 1.41 | 2332 | n/a | 2354 |\n| osiopin | 2671 | penalty | 1332 | 25.53 | copper |  |\n| osuagan | 12.11 | 28.39 | 4613 | 21.80 | 17.19 | calendar |\n| ec-sorrel-small | 10.51 | 25.30 | 21.99 | 11.52 | goblet | 3.87 |'),
)
