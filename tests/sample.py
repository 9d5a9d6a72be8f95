"""A small invented system, for tests that need source text."""

FILES = {
    "app/Orders.bas": '''Attribute VB_Name = "Orders"
Option Explicit
Private Const DB_PASSWORD As String = "s3cr et"
Private m_cnn As Object

Public Function PlaceOrder(ByVal customerId As Long, total As Currency) As Boolean
    Dim sql As String
    If Not Checks.IsKnown(customerId, total) Then
        ' nobody we know
        Exit Function
    End If
    If total > creditLimit Then
        SetStatus customerId, "BLOCKED"
        Exit Function
    End If
    sql = "INSERT INTO ORDERS (ID, TOTAL) VALUES (" & customerId & ", " & total & ")"
    Call Store.RunSql(sql)
    SetStatus customerId, "PLACED"
    Notify customerId, Format(total, "0.00")
    PlaceOrder = True
End Function

Public Sub SetStatus(id, value As String)
    Store.RunSql "UPDATE CUSTOMERS SET STATUS = '" & value & "' WHERE ID = " & id
End Sub

Private Sub Notify(id, text)
    On Error Resume Next
    MsgBox "order of " & id & _
        " is " & text
End Sub
''',
    "app/Checks.bas": '''Attribute VB_Name = "Checks"
Public Function IsKnown(id As Long, total) As Boolean
    Dim rs As Object
    Set rs = Store.OpenSql("SELECT ID, NAME FROM V_CUSTOMERS WHERE ID = " & id)
    If rs.EOF = True Then
        Exit Function
    End If
    IsKnown = IsPositive(total)
End Function

Public Function IsPositive(x) As Boolean
    IsPositive = (x > 0)
End Function
''',
    "app/Store.cls": '''Attribute VB_Name = "Store"
Public Sub RunSql(sql As String)
    m_cnn.Execute sql
End Sub
Public Function OpenSql(sql As String) As Object
    Set OpenSql = CreateObject("ADODB.Recordset")
End Function
Public Sub Audit(P_CODE As Long, P_RESULT As String)
    Dim cmd As New Command
    cmd.CommandText = "{call audit.log_entry(?, ?)}"
    cmd.RegisterOut "P_RESULT", 200
End Sub
Public Sub Finish()
    Exit Sub
End Sub
''',
    "app/Main.frm": '''VERSION 5.00
Begin VB.Form MainForm
   Begin VB.CommandButton cmdSave
   End
End
Attribute VB_Name = "MainForm"
Private Sub cmdSave_Click()
    If Orders.PlaceOrder(CLng(txtId), 5) Then
        Load Checks
    End If
    Finish
End Sub
''',
    "app/Broken.bas": 'Attribute VB_Name = "Broken"\nSub X()\n  y = "no end\nEnd Sub\n',
    "app/shop.vbp": "Type=Exe\nForm=Main.frm\nModule=Orders; Orders.bas\nModule=Gone; Gone.bas\nClass=Store; Store.cls\n",
}
