"""Small Structured Text sources."""

FILES = {
    "plant/FB_Device.st": """FUNCTION_BLOCK FB_Device
VAR_IN_OUT
  Alarm : BOOL;
END_VAR
VAR
  hours, starts : UDINT;
END_VAR
  starts := starts + 1;
  IF Alarm THEN hours := 0; END_IF
END_FUNCTION_BLOCK""",
    "plant/FB_Pump.st": """FUNCTION_BLOCK FB_Pump EXTENDS FB_Device IMPLEMENTS I_Service
VAR_INPUT
  Level : REAL;
END_VAR
VAR
  drive : FB_Motor;
END_VAR
  drive(Speed := Level);
END_FUNCTION_BLOCK""",
    "plant/FB_Motor.st": """FUNCTION_BLOCK FB_Motor
VAR_INPUT Speed : REAL := 0.0; END_VAR
VAR_OUTPUT Torque : REAL; END_VAR
IF Speed > 10.0 THEN
  Torque := Speed * 0.02;
END_IF
END_FUNCTION_BLOCK""",
    "plant/PRG_Station.st": """PROGRAM PRG_Station
VAR
  inlet : FB_Pump;
  spare : FB_Device;
  wet : BOOL;
END_VAR
  spare(Alarm := wet);
  IF wet THEN
    inlet(Level := 2.5);
  END_IF
END_PROGRAM""",
    "short/FB_Valve.st": """FUNCTION_BLOCK FB_Valve
VAR_OUTPUT shut : BOOL; END_VAR END_FUNCTION_BLOCK""",
    "short/FB_Blank.st": """FUNCTION_BLOCK FB_Blank
END_FUNCTION_BLOCK""",
}

MIXED = """TYPE E_State : (Idle, Run := 2, (* c *) Stop); END_TYPE
TYPE
  ST_A : STRUCT
    a, b : INT := 3;
    s : STRING := 'x;VAR y';
  END_STRUCT;
  ALIAS1 : ARRAY[0..3] OF ST_A;
END_TYPE
VAR_GLOBAL
  g1, g2 : INT;
END_VAR
FUNCTION_BLOCK ABSTRACT FB_Mixed
  EXTENDS FB_Device
  IMPLEMENTS I_A , I_B
VAR CONSTANT c : INT := 5; END_VAR
VAR st : E_State; t AT %IX0.0 : BOOL; x : POINTER TO FB_Motor; END_VAR
METHOD PUBLIC Run : BOOL
VAR_INPUT k : INT; END_VAR
  FB_Motor(Speed := 1); ABS(3); INT_TO_REAL(k); // FB_Device(1)
END_METHOD
VAR_TEMP late : REAL; END_VAR
CASE st OF
  Idle: st := Run;
  Run, 5:
     IF a THEN st := Stop; END_IF
     CASE q OF 0: q := 1; 1: q := 2; END_CASE
  Stop:
    st := Idle;
  ELSE
    st := Idle;
END_CASE
END_FUNCTION_BLOCK
INTERFACE I_A
METHOD Run : BOOL
END_METHOD
END_INTERFACE
"""


def corpus(spark, files=None):
    return spark.createDataFrame(list((files or FILES).items()), "path STRING, content STRING")
